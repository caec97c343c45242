import os

from pyspark.sql import functions as F

from sigloom.operators import extract
from sigloom.sources import corpus, index


def test_registry_descriptors_tree_and_index(spark, tmp_path):
    lib = tmp_path / "lib1"
    (lib / "src" / "A").mkdir(parents=True)
    (lib / "alt" / "A").mkdir(parents=True)
    (lib / "src" / "A" / "B.src").write_text("module A.B where\nf : X\n")
    (lib / "alt" / "A" / "B.src").write_text("module A.B where\ng : Y\n")    # later dir wins (S5)
    (lib / "src" / "C.src").write_text("module C where\nh : Z\n")
    (lib / "src" / "note.txt").write_text("not a module")
    (lib / "lib1.desc").write_text("name: mylib \ninclude: src\n  include: alt, \n")
    reg = tmp_path / "registry"
    reg.write_text(str(lib / "lib1.desc") + "\n\n")
    libs = corpus.read_libraries(spark, str(reg))
    assert sorted((r["library"], r["ord"], os.path.basename(r["include_dir"])) for r in libs.collect()) == \
        [("mylib", 0, "src"), ("mylib", 1, "alt")]
    mods = corpus.read_modules(spark, libs, ".src")
    got = {r["module"]: r["text"] for r in mods.collect()}
    assert set(got) == {"A.B", "C"} and "g : Y" in got["A.B"]
    defs = extract.extract_definitions(mods.select("library", "module", "text"))
    out = str(tmp_path / "index")
    index.write_index(defs, out)
    back = index.read_index(spark, out, ["mylib"])
    assert sorted(r["name"] for r in back.collect()) == ["g", "h"]
    sel = spark.createDataFrame([("mylib", "C", True), ("mylib", "A.B", False)], "library string, module string, enabled boolean")
    assert [r["name"] for r in index.select_modules(back, sel).collect()] == ["h"]
    assert sorted(tuple(r["path"]) for r in index.catalog(back).collect()) == [("A", "B"), ("C",)]
    files = corpus.source_files(spark, libs, ".src").select("path")
    res = corpus.resolve_files(back.select("library", "module", "name").unionByName(
        spark.createDataFrame([("other", "Q", "q")], "library string, module string, name string")), libs, files, ".src")
    r = {x["name"]: (x["source_path"], x["error"]) for x in res.collect()}
    assert r["h"][0].endswith("src/C.src") and r["h"][1] is None
    assert r["g"][0].endswith("src/A/B.src")       # J10: first include dir that holds the file
    assert r["q"] == (None, "unknown library")


def test_reindexing_a_module_keeps_the_others(spark, tmp_path):
    def defs(*mods):
        rows = [("L", m, f"module {m} where\n{n} : X\n") for m, n in mods]
        return extract.extract_definitions(spark.createDataFrame(rows, "library string, module string, text string"))
    out = str(tmp_path / "index")
    index.write_index(defs(("A", "a1"), ("B", "b1")), out)
    index.write_index(defs(("A", "a2")), out)
    assert sorted(r["name"] for r in index.read_index(spark, out).collect()) == ["a2", "b1"]
