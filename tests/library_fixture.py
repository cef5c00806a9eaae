"""A small library as literal tables; each row pins a rule."""

from stacksift.model import Library

TYPES = {1: "journalArticle", 2: "book", 3: "attachment", 4: "note", 5: "annotation", 6: "case", 7: "preprint"}
FIELDS = {1: "title", 2: "date", 3: "abstractNote", 4: "DOI", 5: "caseName", 6: "extra", 7: "publicationTitle", 8: "url"}
#: itemID, type, library, values by field, creators, tags
ITEMS = [
    (1, 1, 1, {1: "Über Müller – a study", 2: "2021-03-00 03/2021", 4: "10.1234/ABC"}, [("Jörg", "Müller")], ["Draft", "ai"]),
    (2, 1, 1, {1: "100% of under_score", 2: "2016-10-05 October 2016"}, [("Ann", "Cladder-Micus")], ["draft"]),
    (3, 2, 1, {1: "Plain book", 2: "1999-00-00 1999"}, [("", "World Health Org")], []),
    (4, 2, 1, {1: "No creators"}, [], ["ai"]),
    (5, 6, 1, {5: "Roe v. Doe", 2: "1973-01-22 1973"}, [("A", "Muller")], []),
    (6, 1, 1, {1: "Trashed", 4: "10.1234/abc"}, [("B", "Müller")], ["gone"]),
    (7, 3, 1, {1: "file.pdf"}, [], []),
    (8, 4, 1, {}, [], []),
    (9, 5, 1, {}, [], []),
    (10, 1, 2, {1: "In a group", 4: "https://doi.org/10.1234/abc", 6: "Citation Key: grp99\nfoo: bar"}, [("C", "Lee")], ["ai"]),
    (11, 7, 3, {1: "Feed entry"}, [], []),
]


def key(i: int) -> str:
    return f"KEY{i:05d}"


def library(spark) -> Library:
    values = sorted({v for r in ITEMS for v in r[3].values()})
    names = sorted({c for r in ITEMS for c in r[4]})
    tags = sorted({t for r in ITEMS for t in r[5]})
    make = spark.createDataFrame
    t = {
        "libraries": make([(1, "user"), (2, "group"), (3, "feed")], "libraryID long, type string"),
        "groups": make([(77, 2, "Our group", "", 1)], "groupID long, libraryID long, name string, description string, version long"),
        "itemTypes": make(list(TYPES.items()), "itemTypeID int, typeName string"),
        "fields": make(list(FIELDS.items()), "fieldID int, fieldName string"),
        "items": make([(r[0], key(r[0]), r[1], r[2], f"2024-01-{r[0]:02d} 00:00:00", f"2024-02-{r[0]:02d} 00:00:00") for r in ITEMS], "itemID long, key string, itemTypeID int, libraryID long, dateAdded string, dateModified string"),
        "itemData": make([(r[0], f, values.index(v)) for r in ITEMS for f, v in r[3].items()], "itemID long, fieldID int, valueID long"),
        "itemDataValues": make(list(enumerate(values)), "valueID long, value string"),
        "creatorTypes": make([(1, "author")], "creatorTypeID int, creatorType string"),
        "creators": make([(i, a or None, b) for i, (a, b) in enumerate(names)], "creatorID long, firstName string, lastName string"),
        "itemCreators": make([(r[0], names.index(c), 1, k) for r in ITEMS for k, c in enumerate(r[4])], "itemID long, creatorID long, creatorTypeID int, orderIndex int"),
        "tags": make(list(enumerate(tags)), "tagID long, name string"),
        "itemTags": make([(r[0], tags.index(x), 0) for r in ITEMS for x in r[5]], "itemID long, tagID long, type int"),
        "deletedItems": make([(6,)], "itemID long"),
        "itemAttachments": make([(7, 1, 0, "application/pdf", "storage:file.pdf")], "itemID long, parentItemID long, linkMode int, contentType string, path string"),
        "itemNotes": make([(8, 2, "<p>First line</p><p>needle here</p>")], "itemID long, parentItemID long, note string"),
        "itemAnnotations": make([(9, 7, 1, "needle in text", "", "#ffd400", "3", "00002|000010|00100", '{"pageIndex": 2}')], "itemID long, parentItemID long, type int, text string, comment string, color string, pageLabel string, sortIndex string, position string"),
        "collections": make([(1, "Top", None, 1, "COLLTOP1"), (2, "Sub", 1, 1, "COLLSUB1"), (3, "Loop A", 4, 1, "COLLLPA1"), (4, "Loop B", 3, 1, "COLLLPB1")], "collectionID long, collectionName string, parentCollectionID long, libraryID long, key string"),
        "collectionItems": make([(1, 1), (2, 2)], "collectionID long, itemID long"),
        "baseFieldMappingsCombined": make([(6, 1, 5)], "itemTypeID int, baseFieldID int, fieldID int"),
        "relationPredicates": make([(1, "dc:relation")], "predicateID long, predicate string"),
        "itemRelations": make([(1, 1, f"x/users/0/items/{key(2)}")], "itemID long, predicateID long, object string"),
    }
    return Library(spark, t, group_id=0)
