"""Catalogue of account folders."""

from quiltframe.sources import folders

SCHEMA = "path string, width int, height int"


def test_catalogue(spark):
    files = [
        # whole in both roots, under two spellings: the first root counts
        ("/a/S1/anhle/g10.png", 100, 50), ("/a/S1/anhle/g9.JPG", 90, 52), ("/a/S1/anhle/note.txt", 1, 1), ("/a/S1/any.png", 999, 999), ("/a/S1/s1.PNG", 250, 150),
        ("/b/s1/anhle/x.png", 10, 10), ("/b/s1/s1.png", 10, 10),
        # no reference in the first root but a preview; other names will do in the second
        ("/a/S2/anhle/x.png", 10, 10), ("/a/S2/Xem_truoc_1.png", 10, 10), ("/b/S2/anhle/x.png", 40, 30), ("/b/S2/other.png", 100, 75), ("/b/S2/zz.png", 900, 900),
        # no single pictures, deeper files, names that are no accounts, files elsewhere
        ("/a/S3/S3.png", 10, 10), ("/a/S3/anhle/deep/x.png", 10, 10), ("/a/assets/anhle/x.png", 1, 1), ("/a/assets/assets.png", 1, 1), ("/a/S4./anhle/x.png", 1, 1), ("/a/S4./S4.png", 1, 1),
        ("/c/S5/anhle/x.png", 1, 1), ("/c/S5/S5.png", 1, 1), ("/a/lone.png", 1, 1), (None, 1, 1),
        # below a root in a root
        ("/a/standalone/S6/anhle/x.png", 30, 30), ("/a/standalone/S6/S6.png", 61, 10),
        # two spellings below one root; sizes unknown
        ("/a/s7/anhle/x.png", None, None), ("/a/s7/s7.png", 10, 10), ("/a/S7/anhle/x.png", None, None), ("/a/S7/S7.png", 10, 10),
    ]
    df = spark.createDataFrame(files, SCHEMA)
    roots = ["/a", "/b/", "/a/standalone"]
    got = {r.code: (r.folder, r.place, r["count"], r.columns, r.rows, r.reference) for r in folders.catalogue(df, roots).collect()}
    seven = got.pop("S7", None) or got.pop("s7")
    assert seven[2:5] == (1, None, None)
    assert got == {
        "S1": ("/a/S1", 0, 2, 2, 3, "/a/S1/s1.PNG"),  # 250 / 100 is 2.5, rounded to even
        "S2": ("/b/S2", 1, 1, 2, 2, "/b/S2/other.png"),
        "S6": ("/a/standalone/S6", 2, 1, 2, 1, "/a/standalone/S6/S6.png"),
    }
    layouts = spark.createDataFrame([("/a/S1", 7, 8), ("/b/s1", 9, 9)], "folder string, columns int, rows int")
    known = folders.catalogue(df, roots, layouts)
    told = {r.code: (r.columns, r.rows) for r in known.collect()}
    assert told["S1"] == (7, 8) and told["S2"] == (2, 2)
    listed = {}
    for r in folders.items(df, roots, known).orderBy("code", "pos").collect():
        listed.setdefault(r.code, []).append(r.path.rsplit("/", 1)[1])
    assert listed["S1"] == ["g9.JPG", "g10.png"] and listed["S2"] == ["x.png"] and sum(k in listed for k in ("S7", "s7")) == 1


def test_no_files(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert folders.catalogue(none, ["/a"]).count() == 0 and folders.items(none, ["/a"], folders.catalogue(none, ["/a"])).count() == 0
