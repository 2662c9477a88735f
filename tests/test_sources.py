import pytest

from shelfmark.sources import sinks, tables


def test_rating_csv_and_golden(spark, tmp_path):
    from shelfmark.operators.cf import item_cosine

    path = tmp_path / "r.csv"
    path.write_text("1,u1,a,5\n2,u1,b,5\n3,u2,a,3\n4,u2,b,1\n5,u3,c,4\n")
    got = {(r.item_1, r.item_2): (r.score, r.strength) for r in item_cosine(tables.rating_csv(spark, str(path))).collect()}
    assert got == {("a", "b"): (round(28 / (34**0.5 * 26**0.5), 6), 2)}


def test_sorted_csv_skips_header_and_pads(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('"x","user_id","isbn","rating"\n\n"1","u1","123","7"\n"2","u2","12345678901","0"\n')
    got = {tuple(r) for r in tables.sorted_rating_csv(spark, str(path)).collect()}
    assert got == {("u1", "0000000123", 7.0), ("u2", "12345678901", 0.0)}


def test_user_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "a", 5.0), ("u1", "b", 3.0), ("u2", "a", 1.0)], "user_id string, item_id string, rating double")
    sinks.write_user_lines(df, str(tmp_path / "out"))
    assert {tuple(r) for r in tables.user_lines(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in df.collect()}


def test_text_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    assert [r.item_id for r in tables.raw_asins(spark, put("raw", '{"asin": "0123456789", "x": 1}\nnothing\n')).collect()] == ["0123456789"]
    assert tables.review_json(spark, put("json", '{"asin": "1", "reviewerID": "r", "overall": 4.0, "reviewText": "t"}\n')).first().overall == 4.0
    assert tables.nested_documents(spark, put("nested", "[['a', 'b'], ['c']]\n")).first().sentences == [["a", "b"], ["c"]]
    assert tuple(tables.described_items(spark, put("desc", "ISBN12: Some text\n\n")).first()) == ("12", "Some text")
    assert tuple(tables.vectors_text(spark, put("vec", "1: [4, 3]\n")).first()) == (1, [4, 3])
    assert [r.item_id for r in tables.id_lines(spark, put("ids", " a \n\nb\n")).collect()] == ["a", "b"]
    (tmp_path / "latin").write_bytes("7,caf\xe9\n".encode("latin-1"))
    assert tables.first_field_csv(spark, str(tmp_path / "latin")).first().item_id == "0000000007"


def test_subsets_literals_and_sparse_matrices(spark, tmp_path):
    import numpy as np

    (tmp_path / "r.csv").write_text("u1,a,5\nu2,b,3\nu3,c,1\n")
    ids = spark.createDataFrame([("a",), ("c",), ("a",)], "item_id string")
    assert {tuple(r) for r in tables.subset_csv(spark, str(tmp_path / "r.csv"), ids).collect()} == {("u1", "a", 5.0), ("u3", "c", 1.0)}
    (tmp_path / "h.csv").write_text("x, y\n1, b\n")
    assert tables.header_csv(spark, str(tmp_path / "h.csv")).first().asDict() == {"x": 1, "y": "b"}
    (tmp_path / "lit").write_text("{'a': 0, 'b c': 1}\n")
    assert {tuple(r) for r in tables.index_literal(spark, str(tmp_path / "lit")).collect()} == {("a", 0), ("b c", 1)}
    (tmp_path / "v").write_text("1: 3\n2: 10\n")
    assert [tuple(r) for r in tables.rating_text(spark, str(tmp_path / "v")).collect()] == [(1, 3), (2, 10)]
    m = np.array([[0, 2, 0], [0, 0, 0], [1, 0, 3.5]])
    np.savez(tmp_path / "m.npz", data=m[m > 0], indices=np.nonzero(m)[1], indptr=[0, 1, 1, 3], shape=m.shape)
    cells = tables.npz_triples(spark, str(tmp_path / "m.npz")).select("row", "col", "value")
    assert {tuple(r) for r in cells.collect()} == {(0, 1, 2.0), (2, 0, 1.0), (2, 2, 3.5)}
    sinks.write_triples(cells, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_lists_queues_and_reports(spark, tmp_path):
    words = spark.createDataFrame([("a", 1), ("b", 2)], "term string, n int")
    sinks.write_words(words, str(tmp_path / "w"))
    assert {r.item_id for r in tables.id_lines(spark, str(tmp_path / "w")).collect()} == {"a", "b"}
    sinks.write_pairs(words, str(tmp_path / "d"), "term", "n")
    assert {(r.key, r.value) for r in spark.read.json(str(tmp_path / "d")).collect()} == {("a", 1), ("b", 2)}
    left = sinks.consume(words, words.where("term = 'a'"), "term", str(tmp_path / "q"))
    assert [r.term for r in left.collect()] == ["b"]
    sinks.write_csv(words, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.header_csv(spark, str(tmp_path / "c")).collect()} == {("a", 1), ("b", 2)}
    assert sinks.report(words, 1).split() == ["term", "n", "a", "1"]
    assert sinks.result_path("/x/", "nb", "tfidf", "paired", 10) == "/x/learner=nb/data=tfidf/selection=paired/features=10"


def test_responses(spark):
    rows = spark.createDataFrame([('{"totalItems": 1, "items": [{"volumeInfo": {"description": "d"}}]}', "<r><book><description>x</description></book></r>"), ('{"totalItems": 0}', "<r><book><description> </description></book></r>")], "j string, x string")
    got = rows.select(tables.description_of(rows.j).alias("a"), tables.xml_description(rows.x).alias("b")).collect()
    assert [tuple(r) for r in got] == [("d", "x"), (None, None)]


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_stage(df, str(tmp_path / "p"), "v")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_throttle():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = sinks.Throttle(2.0, 3, lambda: now[0], sleep)
    for _ in range(4):
        t.wait()
    assert slept[:2] == [2.0, 2.0] and now[0] >= 86_400


@pytest.mark.parametrize("value, want", [("1", "0000000001"), ("12345678901", "12345678901")])
def test_pad(spark, value, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(tables.pad_id(F.lit(value)).alias("x")).first().x == want
