from sigloom.operators import extract

CORPUS = """module Top where

f : Nat -> Nat
f x = x

g : {A : Set}
  -> A
  -> A

module Inner where
  h : Nat

  record R (A : Set) : Set where
    constructor mkR
    field
      fst : A
    field snd : Nat

data D : Set where
  c1 : D

private
  secret : Nat
  data Hidden : Set where

pattern p x = c1

postulate
  ax : Nat

module _ where
  anon : Nat

foo : Nat
foo = k
  where
  k : Nat
"""


def test_extraction_rules(spark):
    df = spark.createDataFrame([("lib", "M", CORPUS)], "library string, module string, text string")
    got = {(r["name"], r["kind"], r["inner_path"], r["type_raw"])
           for r in extract.extract_definitions(df).collect()}
    assert got == {
        ("f", "Function", "", ": Nat -> Nat"),
        ("g", "Function", "", ": {A : Set} -> A  -> A "),
        ("h", "Function", "Inner.", ": Nat"),
        ("R", "RecordType", "Inner.", "(A : Set) : Set"),
        ("mkR", "RecordConstructor", "Inner.R.", None),
        ("fst", "RecordField", "Inner.R.", ": A"),
        ("snd", "RecordField", "Inner.R.", "Nat"),
        ("D", "DataType", "", ": Set"),
        ("c1", "DataConstructor", "", ": D"),
        ("Hidden", "DataType", "", ": Set"),      # data inside private is still emitted
        ("p", "Pattern", "", "x = c1"),
        ("ax", "Function", "", ": Nat"),          # postulate is transparent
        ("anon", "Function", "", ": Nat"),        # module _ adds no scope
        ("foo", "Function", "", ": Nat"),         # k under where is dropped
    }


def test_signature_at_end_of_file_and_blank_lines(spark):
    df = spark.createDataFrame([("l", "m", "\n\nz : A\n\n  -> B")], "library string, module string, text string")
    rows = extract.extract_definitions(df).collect()
    assert [(r["name"], r["type_raw"]) for r in rows] == [("z", ": A -> B ")]


def test_type_enrichment_worklist_progress(spark):
    defs = spark.createDataFrame([("l", "m", "", "f", ": A"), ("l", "m", "", "g", ": B"), ("l", "n", "", "c", None)],
                                 "library string, module string, inner_path string, name string, type_raw string")
    inferred = spark.createDataFrame([("l", "m", "", "f", "A", None), ("l", "m", "", "g", None, "boom")],
                                     "library string, module string, inner_path string, name string, "
                                     "type_normalised string, error string")
    e = {r["name"]: (r["type_normalised"], r["type_error"]) for r in extract.attach_inferred_types(defs, inferred).collect()}
    assert e == {"f": ("A", None), "g": (None, "boom"), "c": (None, None)}
    assert extract.type_worklist(defs, inferred.limit(1)).select("name").first()["name"] == "g"
    res = extract.attach_inferred_types(defs, inferred).withColumnRenamed("type_error", "error")
    p = extract.progress_counts(res).first()
    assert (p["processed"], p["indexed"], p["failed"], p["modules"]) == (3, 2, 1, 2)
