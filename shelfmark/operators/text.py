"""Text operators: sentences, tokens, vocabularies, TF-IDF and sentiment in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.words import MODIFIERS, PHRASES, STOP_WORDS, WEIGHTS, caveat, clean_tokens, letter_words, phrased_words, sentences, simple_tag
from ..plans.registry import query
from ..plans.stages import materialize
from ..sources.tables import table

_STOP = ", ".join(f"('{w}')" for w in STOP_WORDS)
TOK = f"""tok AS (SELECT doc_id, w AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+')) AS w FROM documents) WHERE w <> ''),
stop AS (SELECT * FROM (VALUES {_STOP}) s(term)),
voc AS (SELECT term FROM tok WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1 HAVING count(*) >= 10),
tf AS (SELECT doc_id, term, c / sum(c) OVER (PARTITION BY doc_id) AS tf FROM (SELECT doc_id, term, count(*) AS c FROM tok JOIN voc USING (term) GROUP BY 1, 2)),
idf AS (SELECT term, 1 + ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM tf GROUP BY 1),
tfidf AS (SELECT doc_id, term, round(tf * idf, 9) AS weight FROM tf JOIN idf USING (term))"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(letter_words(F.col("text"))).alias("term"))


def stop_words(spark: SparkSession) -> DataFrame:
    """A fixed list."""
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")


def vocabulary(tok: DataFrame, least: int = 10) -> DataFrame:
    """Terms with at least so many occurrences, without stop words."""
    counts = tok.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(F.broadcast(stop_words(tok.sparkSession)), "term", "left_anti")


def term_frequency(tok: DataFrame, voc: DataFrame) -> DataFrame:
    """doc_id, term, tf: shares of the in-vocabulary words of a document. Counts come first, so the join is small."""
    counts = tok.groupBy("doc_id", "term").agg(F.count("*").alias("c")).join(voc.select("term"), "term")
    return counts.select("doc_id", "term", (F.col("c") / F.sum("c").over(Window.partitionBy("doc_id"))).alias("tf"))


def inverse_frequency(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """1 + ln(N / (df + 1)); n_docs: one row, N."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", (1 + F.ln(F.col("N") / (F.col("df") + 1))).alias("idf"))


def tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Words are counted once per document and written; vocabulary, shares and document frequencies read the counts."""
    counts = materialize(tokens(spark, sf).groupBy("doc_id", "term").agg(F.count("*").alias("c")), "word-counts")
    voc = counts.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("df")).where("n >= 10").drop("n").join(F.broadcast(stop_words(spark)), "term", "left_anti")
    n_docs = table(spark, sf, "documents").agg(F.count("*").alias("N"))
    idf = voc.join(F.broadcast(n_docs)).select("term", (1 + F.ln(F.col("N") / (F.col("df") + 1))).alias("idf"))
    tf = F.col("c") / F.sum("c").over(Window.partitionBy("doc_id"))
    return counts.join(idf, "term").select("doc_id", "term", F.round(tf * F.col("idf"), 9).alias("weight"))


@query("sentences", "SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[.?!]'), lambda s: s <> '')) AS sentence FROM documents")
def sentences_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(sentences(F.coalesce("text", F.lit("")))).alias("sentence"))


@query("tokens_clean", """SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '<[^>]*>|&[a-z]+;', ' ', 'g'), '\\s+'),
  lambda w: lower(trim(regexp_replace(w, '’s|''s|“|”', '', 'g'), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')))) AS token FROM documents) WHERE token <> '' GROUP BY 1, 2""")
def tokens_clean(spark, sf):
    words = F.explode(clean_tokens(F.coalesce("text", F.lit("")))).alias("token")
    return table(spark, sf, "documents").select("doc_id", words).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("multi_source_text", """WITH a AS (SELECT doc_id AS id, 1 AS src, 0 AS part, coalesce(text, '') AS text FROM documents),
b AS (SELECT conv_id AS id, 2 AS src, turn AS part, coalesce(text, '') AS text FROM conversations), c AS (SELECT page_id AS id, 3 AS src, 0 AS part, coalesce(url, '') AS text FROM pages)
SELECT id, string_agg(text, ' ' ORDER BY src, part) AS text, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE id IN (SELECT p_partkey FROM part) GROUP BY 1""")
def multi_source_text(spark, sf):
    """Three text streams by id, in source order: a tagged union and an ordered aggregate, for ids of the list."""
    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return _source_texts(spark, sf).join(wanted, "id", "left_semi").groupBy("id").agg(_merged_text().alias("text"), F.count("*").alias("n"))


def _source_texts(spark, sf) -> DataFrame:
    """id, src, part, text of the three sources."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("src"), F.lit(0).cast("long").alias("part"), "text")
    b = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit(2).alias("src"), F.col("turn").alias("part"), "text")
    c = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit(3).alias("src"), F.lit(0).cast("long").alias("part"), F.col("url").alias("text"))
    return a.unionByName(b).unionByName(c)


def _merged_text():
    row = F.struct("src", "part", F.coalesce("text", F.lit("")).alias("text"))
    return F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(row)), lambda r: r["text"]))


@query("multi_source_cogroup", """WITH a AS (SELECT doc_id AS id, 1 AS src, 0 AS part, coalesce(text, '') AS text FROM documents),
b AS (SELECT conv_id AS id, 2 AS src, turn AS part, coalesce(text, '') AS text FROM conversations), c AS (SELECT page_id AS id, 3 AS src, 0 AS part, coalesce(url, '') AS text FROM pages),
s AS (SELECT id, string_agg(text, ' ' ORDER BY src, part) AS text, count(*) FILTER (src = 1) AS n_1, count(*) FILTER (src = 2) AS n_2, count(*) FILTER (src = 3) AS n_3 FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1)
SELECT coalesce(s.id, p_partkey) AS id, sha256(coalesce(text, '')) AS text_sha256, coalesce(n_1, 0) AS n_1, coalesce(n_2, 0) AS n_2, coalesce(n_3, 0) AS n_3, p_partkey IS NOT NULL AS listed FROM s FULL JOIN part ON p_partkey = s.id""")
def multi_source_cogroup(spark, sf):
    """Every id of a source or of the list: its text digest, the parts that each source has of it, whether it is listed."""
    s = _source_texts(spark, sf).groupBy("id").agg(_merged_text().alias("text"), *[F.count_if(F.col("src") == i).alias(f"n_{i}") for i in (1, 2, 3)])
    listed = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("listed"))
    out = s.join(listed, "id", "full")
    return out.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), *[F.coalesce(f"n_{i}", F.lit(0)).cast("long").alias(f"n_{i}") for i in (1, 2, 3)], F.coalesce("listed", F.lit(False)).alias("listed"))


@query("word_counts_capped", f"WITH {TOK} SELECT term, least(count(*), 10)::BIGINT AS n FROM tok GROUP BY 1")
def word_counts_capped(spark, sf):
    return tokens(spark, sf).groupBy("term").agg(F.least(F.count("*"), F.lit(10)).alias("n"))


@query("narrowed_dict", f"WITH {TOK} SELECT term FROM voc")
def narrowed_dict(spark, sf):
    return vocabulary(tokens(spark, sf)).select("term")


@query("dict_minus_stop", f"WITH {TOK} SELECT DISTINCT term FROM tok WHERE term NOT IN (SELECT term FROM stop)")
def dict_minus_stop(spark, sf):
    return tokens(spark, sf).select("term").distinct().join(F.broadcast(stop_words(spark)), "term", "left_anti")


#: What the queries take for nouns and for opinion words of the synthetic prose.
NOUNS = ["ander", "aning", "attion", "eriner", "estion", "hand", "inge", "iner", "ntion", "ontion", "reat", "thing", "tion", "toner", "thou", "thnd", "anea", "oner", "reha", "innd", "heti", "hest", "hain", "edst", "onor", "reti"]
OPINIONS = [("good", 1), ("worthless", -1), ("pathetic", -1), ("ering", 1), ("eron", -1), ("onti", 1), ("stion", 1), ("thre", 1), ("ble", 1), ("thth", -1), ("thin", -1), ("thly", 1), ("eren", -1), ("erst", 1), ("erre", -1), ("thha", 1), ("onon", -1), ("only", -1), ("anon", 1), ("erly", 1), ("hean", -1), ("rely", 1), ("heon", -1), ("eden", 1)]
_NOUNS = ", ".join(f"('{n}')" for n in NOUNS)


@query("noun_filter", f"WITH {TOK} SELECT DISTINCT term FROM tok WHERE term IN (SELECT n FROM (VALUES {_NOUNS}) t(n)) AND term NOT IN (SELECT term FROM stop)")
def noun_filter(spark, sf):
    """Vocabulary terms that a list calls nouns, without stop words and opinion words."""
    nouns = spark.createDataFrame([(n,) for n in NOUNS], "term string")
    opinions = spark.createDataFrame(OPINIONS, "term string, polarity int").select("term")
    return tokens(spark, sf).select("term").distinct().join(F.broadcast(nouns), "term").join(F.broadcast(stop_words(spark)), "term", "left_anti").join(F.broadcast(opinions), "term", "left_anti")


_MOD = ", ".join(f"('{m}', {w}, '{c}')" for m, w, c in MODIFIERS)


@query("modifier_parse", f"SELECT modifier, weight::DOUBLE AS weight, CASE WHEN regexp_matches(caveat, '[12]$') THEN CASE WHEN caveat LIKE '%1' THEN 'before' ELSE 'after' END END AS side, CASE WHEN regexp_matches(caveat, '[12]$') THEN left(caveat, -1) END AS word FROM (VALUES {_MOD}) t(modifier, weight, caveat)")
def modifier_parse(spark, sf):
    rows = spark.createDataFrame(MODIFIERS, "modifier string, weight double, caveat string")
    return rows.select("modifier", "weight", caveat(F.col("caveat")).alias("c")).select("modifier", "weight", "c.side", "c.word")


@query("tf", f"WITH {TOK} SELECT doc_id, term, round(tf, 6) AS tf FROM tf")
def tf_(spark, sf):
    tok = tokens(spark, sf)
    return term_frequency(tok, vocabulary(tok)).select("doc_id", "term", F.round("tf", 6).alias("tf"))


@query("idf", f"WITH {TOK} SELECT term, round(idf, 6) AS idf FROM idf")
def idf_(spark, sf):
    tok = tokens(spark, sf)
    tf = term_frequency(tok, vocabulary(tok))
    return inverse_frequency(tf, table(spark, sf, "documents").agg(F.count("*").alias("N"))).select("term", F.round("idf", 6).alias("idf"))


@query("tfidf", f"WITH {TOK} SELECT doc_id, term, round(weight + 1e-10, 6) AS weight FROM tfidf")
def tfidf(spark, sf):
    return tf_idf(spark, sf).select("doc_id", "term", F.round(F.col("weight") + 1e-10, 6).alias("weight"))


@query("tfidf_top_terms", f"WITH {TOK} SELECT doc_id, term, round(weight + 1e-10, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM tfidf) WHERE rank <= 5")
def tfidf_top_terms(spark, sf):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return tf_idf(spark, sf).withColumn("rank", rank.cast("long")).where("rank <= 5").select("doc_id", "term", F.round(F.col("weight") + 1e-10, 6).alias("weight"), "rank")


_JOINED = "list_aggregate(list_transform(regexp_split_to_array(regexp_replace(lower(sentence), 'n[''’]t', 'nt', 'g'), '[^\\p{L}]+'), lambda w: CASE WHEN w <> '' THEN ' ' || w || ' ' ELSE '' END), 'string_agg', '')"
for _p in PHRASES:
    _JOINED = f"replace({_JOINED}, ' {_p[0]}  {_p[1]} ', ' {''.join(_p)} ')"
SENT = f"""st AS (SELECT doc_id, s, list_filter(regexp_split_to_array({_JOINED}, ' +'), lambda w: w <> '') AS ws FROM (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.?!]'), lambda x: x <> '') AS parts FROM documents))),
wd AS (SELECT doc_id, s, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM st),
op AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {p})" for w, p in OPINIONS)}) t(w, polarity)), md AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {w})" for m, w in WEIGHTS.items())}) t(w, weight)), nn AS (SELECT * FROM (VALUES {_NOUNS}) t(w)),
sc AS (SELECT o.doc_id, o.s, o.i, any_value(polarity)::DOUBLE * coalesce(product(m.weight), 1) AS v FROM (SELECT * FROM wd JOIN op USING (w)) o LEFT JOIN (SELECT doc_id, s, i, weight FROM wd JOIN md USING (w)) m ON o.doc_id = m.doc_id AND o.s = m.s AND m.i BETWEEN o.i - 2 AND o.i - 1 GROUP BY 1, 2, 3),
ps AS (SELECT doc_id, s, sum(v) AS v FROM sc GROUP BY 1, 2),
sv AS (SELECT doc_id, w AS term, sum(v) AS weight FROM (SELECT * FROM wd JOIN nn USING (w)) JOIN ps USING (doc_id, s) GROUP BY 1, 2)"""


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment_of(table(spark, sf, "documents"))


def sentiment_of(docs: DataFrame, opinions: list[tuple[str, int]] = OPINIONS, noun_list: list[str] = NOUNS) -> DataFrame:
    """doc_id, term (noun), weight: the polarities of its sentences, opinion words times modifiers in the two words before.

    A modifier of two words counts as one word. All lists are fixed and small; each sentence is scored in its own row by array functions, so nothing shuffles
    but the final sum.
    """
    polarity = F.create_map(*[F.lit(x) for w, p in opinions for x in (w, float(p))])
    weight = F.create_map(*[F.lit(x) for m, w in WEIGHTS.items() for x in (m, w)])
    s = docs.select("doc_id", F.explode(sentences(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", phrased_words(F.col("s")).alias("ws"))
    at = F.sequence(F.lit(1), F.size("ws"))

    def factor(i):
        return F.coalesce(F.try_element_at(weight, F.coalesce(F.get("ws", i - 1), F.lit(""))), F.lit(1.0))

    values = F.transform(at, lambda i: F.coalesce(F.try_element_at(polarity, F.element_at("ws", i)), F.lit(0.0)) * factor(i - 1) * F.when(i >= 3, factor(i - 2)).otherwise(1.0))
    has = F.exists("ws", lambda w: F.array_contains(F.lit([w for w, _ in opinions]), w))
    scored = s.where((F.size("ws") > 0) & has).select("doc_id", "ws", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("v"))
    nouns = F.explode(F.filter("ws", lambda w: F.array_contains(F.lit(noun_list), w))).alias("term")
    return scored.select("doc_id", nouns, "v").groupBy("doc_id", "term").agg(F.sum("v").alias("weight"))


@query("sentiment_vectors", f"WITH {SENT} SELECT doc_id, term, round(weight, 6) AS weight FROM sv")
def sentiment_vectors(spark, sf):
    return sentiment(spark, sf).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("sentiment_top_words", f"WITH {SENT}, t AS (SELECT term, round(sum(weight), 6) AS total FROM sv GROUP BY 1) (SELECT 'high' AS side, term, total FROM t ORDER BY total DESC, term LIMIT 3) UNION ALL (SELECT 'low', term, total FROM t ORDER BY total, term LIMIT 3)")
def sentiment_top_words(spark, sf):
    t = sentiment(spark, sf).groupBy("term").agg(F.round(F.sum("weight"), 6).alias("total"))
    high = t.orderBy(F.desc("total"), "term").limit(3).select(F.lit("high").alias("side"), "term", "total")
    return high.unionByName(t.orderBy("total", "term").limit(3).select(F.lit("low").alias("side"), "term", "total"))


def tagged_nouns(words: DataFrame, tagger: Callable[[list[str]], list[str]], column: str = "term") -> DataFrame:
    """Words whose part-of-speech tag starts with N; tagger maps words to Treebank tags and runs on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(tag=tagger(b[column].tolist()))

    kept = words.select(column).distinct().mapInPandas(run, f"{column} string, tag string")
    return kept.where(F.startswith(F.col("tag"), F.lit("N"))).select(column, simple_tag(F.col("tag")).alias("pos"))


def lemmatized(words: DataFrame, lemmatizer: Callable[[str, str], str] = lambda word, pos: word) -> DataFrame:
    """words (word, pos, ...) with lemma: each distinct pair is looked up once and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(lemma=[lemmatizer(w, p) for w, p in zip(b["word"], b["pos"], strict=True)])

    lemmas = words.select("word", "pos").distinct().mapInPandas(run, "word string, pos string, lemma string")
    return words.join(lemmas, ["word", "pos"])
