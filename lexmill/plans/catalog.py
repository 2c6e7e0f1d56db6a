"""The registered queries of the analytics operators, each with its DuckDB equivalent where SQL can express it.

The driver's documents hold no CJK text, so character classes are letters here; the operators default to CJK.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import scratch
from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.operators import convert, html, ngrams, phrases, segment, stats, suffix, train, vectors
from lexmill.plans import recursive as R
from lexmill.session import table
from lexmill.sources import corpora, dictionaries
from lexmill.streaming import lookups

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "char_ngram_top"
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _r(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def _spread(df: DataFrame) -> DataFrame:
    """Rows of one small file dealt to all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _chars_sql(source: str, text: str, ahead: int) -> str:
    """SQL: a row a character with the next ones as a1, a2, .. (null behind the end) and the one before as b1."""
    rows = f"SELECT d, unnest(string_split(t, '')) AS ch, unnest(range(1, length(t) + 1)) AS p FROM (SELECT row_number() OVER () AS d, {text} AS t FROM {source} WHERE length({text}) > 0)"
    leads = "".join(f", lead(ch, {i}) OVER w AS a{i}" for i in range(1, ahead + 1))
    return f"SELECT d, p, ch, lag(ch) OVER w AS b1{leads} FROM ({rows}) WINDOW w AS (PARTITION BY d ORDER BY p)"


def _grams(source: str, text: str, low: int, high: int) -> str:
    """SQL: every substring of low..high characters as column word."""
    each = " UNION ALL ".join("SELECT " + " || ".join(["ch", *(f"a{i}" for i in range(1, n))]) + " AS word FROM x" for n in range(low, high + 1))
    return f"WITH x AS ({_chars_sql(source, text, high - 1)}) SELECT word FROM ({each}) WHERE word IS NOT NULL"


def _short_grams(source: str, text: str) -> str:
    """SQL: every substring of short texts."""
    one = f"list_transform(range(1, length({text}) + 1), lambda l: list_transform(range(1, length({text}) - l + 2), lambda p: substring({text}, p, l)))"
    return f"SELECT unnest(flatten({one})) AS word FROM {source}"


def _model_sql(source: str, text: str, breaks: str = "[ \\r\\n]", high: int = 4) -> str:
    chunks = f"SELECT chunk, count(*) AS times FROM (SELECT unnest(string_split_regex({text}, '{breaks}')) AS chunk FROM {source}) WHERE chunk <> '' GROUP BY chunk"
    one = f"list_transform(range(1, {high + 1}), lambda l: list_transform(range(1, length(chunk) - l + 2), lambda p: substring(chunk, p, l)))"
    return f"SELECT word, length(word)::INT AS len, sum(times)::BIGINT AS cnt FROM (SELECT times, unnest(flatten({one})) AS word FROM ({chunks})) GROUP BY word"


DOC_MODEL = _model_sql("documents", "text")
PART_MODEL = _model_sql("part", "p_name")


def _documents_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.build_model(_spread(table(spark, sf_dir, "documents").select("text")), "text", 4)


def _part_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.build_model(table(spark, sf_dir, "part"), "p_name", 4)


# N-grams and word models
@query(f"SELECT word, count(*) AS cnt FROM ({_grams('documents', 'text', 2, 2)}) GROUP BY word ORDER BY cnt DESC, word LIMIT 100")
def char_ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent character pairs of all documents."""
    return ngrams.top(ngrams.fixed_counts(_spread(table(spark, sf_dir, "documents").select("text")), "text", 2), 100)


@query(DOC_MODEL)
def trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_model(spark, sf_dir)


@query(f"""
WITH m AS ({PART_MODEL}), w AS (SELECT unnest(string_split(p_type, ' ')) AS word FROM part)
SELECT word, length(word)::INT AS len, sum(cnt)::BIGINT AS cnt
FROM (SELECT word, floor(cnt * 0.5)::BIGINT AS cnt FROM m UNION ALL SELECT word, 1 FROM w) GROUP BY word""")
def trie_insert_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word"))
    return ngrams.add_words(ngrams.decay(_part_model(spark, sf_dir), 0.5), words)


@query(f"SELECT count(*) + 1 AS n_nodes FROM (SELECT DISTINCT left(word, k::INT) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM ({PART_MODEL})))")
def trie_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.node_count(_part_model(spark, sf_dir))


@query(f"SELECT sum(cnt)::BIGINT AS total FROM ({DOC_MODEL})")
def trie_total_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.total_mass(_documents_model(spark, sf_dir))


@query(f"""
WITH g AS ({_grams("conversations", "text", 5, 5)})
SELECT word, count(*) AS cnt FROM g GROUP BY word HAVING count(*) > 1 AND NOT regexp_matches(word, '[\\r\\n]')""")
def repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.repeated(_spread(table(spark, sf_dir, "conversations")), "text", 5)[0]


@query(f"SELECT coalesce(sum(cnt), 0)::BIGINT AS total FROM (SELECT count(*) AS cnt FROM ({_grams('conversations', 'text', 5, 5)}) GROUP BY word HAVING count(*) > 1)")
def repeated_ngrams_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.repeated(_spread(table(spark, sf_dir, "conversations")), "text", 5)[1]


@query(f"SELECT word, length(word)::INT AS len, count(*) AS cnt FROM ({_short_grams('part', 'p_name')}) GROUP BY word HAVING count(*) >= 25")
def frequent_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.frequent_substrings(table(spark, sf_dir, "part"), "p_partkey", "p_name", 25)


# Statistics
@query(f"""
SELECT len, count(*) AS uniq_cnt, round(avg(cnt), 6) + 0.0 AS mean, round(stddev_pop(cnt), 6) + 0.0 AS stddev,
  round(sum(sqrt(cnt)), 6) + 0.0 AS sqrt_sum, round(sum(ln(cnt)), 6) + 0.0 AS log_sum FROM ({DOC_MODEL}) WHERE cnt <> 0 GROUP BY len""")
def length_stats_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.model_length_stats(_documents_model(spark, sf_dir)), "mean", "stddev", "sqrt_sum", "log_sum")


@query(f"""
WITH x AS ({_chars_sql("conversations", "text", 3)}),
g AS ({" UNION ALL ".join(f"SELECT {n} AS len, " + " || ".join(["ch", *(f"coalesce(a{i}, '')" for i in range(1, n))]) + " AS w FROM x" for n in range(1, 5))}),
k AS (SELECT len, w, count(*) AS cnt FROM g GROUP BY len, w),
s AS (SELECT len, cnt, sum(count(*)) OVER (PARTITION BY len ORDER BY cnt) AS upto, sum(count(*)) OVER (PARTITION BY len) AS total FROM k GROUP BY len, cnt),
p AS (SELECT len, min(cnt) AS p01_count FROM s WHERE upto >= 0.01 * total GROUP BY len)
SELECT len, count(*) AS uniq_cnt, round(avg(cnt), 6) + 0.0 AS mean, round(stddev_pop(cnt), 6) + 0.0 AS stddev, round(sum(sqrt(cnt)), 6) + 0.0 AS sqrt_sum,
  round(sum(ln(cnt + 1)), 6) + 0.0 AS log_sum, any_value(p01_count) AS p01_count FROM k JOIN p USING (len) GROUP BY len""")
def length_stats_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.text_length_stats(_spread(table(spark, sf_dir, "conversations")), "text", 4), "mean", "stddev", "sqrt_sum", "log_sum")


@query(f"""
SELECT cnt, sum(words)::BIGINT AS words FROM (SELECT cnt, count(*) AS words FROM ({DOC_MODEL}) WHERE len = 3 GROUP BY cnt
UNION ALL SELECT unnest(range(1, 11)), 0) GROUP BY cnt""")
def words_per_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.words_per_count(_documents_model(spark, sf_dir), 3)


@query(f"""
WITH m AS ({DOC_MODEL}), n AS (SELECT left(word, len - 1) AS word, cnt, sum(cnt) OVER (PARTITION BY left(word, len - 1)) AS s FROM m WHERE len > 1)
SELECT word, round(sum(-(cnt / s) * ln(cnt / s)), 6) + 0.0 AS entropy FROM n GROUP BY word""")
def next_char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.next_char_entropy(_documents_model(spark, sf_dir)), "entropy")


# Phrases
_SIGNALS = f"""
WITH y AS ({_chars_sql("conversations", "text", 3)}),
o AS (SELECT {{'word': ch, 'len': 1, 'next': a1, 'prev': b1}} AS x FROM y UNION ALL SELECT {{'word': ch || a1, 'len': 2, 'next': a2, 'prev': b1}} FROM y WHERE a1 IS NOT NULL
  UNION ALL SELECT {{'word': ch || a1 || a2, 'len': 3, 'next': a3, 'prev': b1}} FROM y WHERE a2 IS NOT NULL),
f AS (SELECT x.word AS word, x.len AS len, count(*) AS freq FROM o GROUP BY 1, 2),
p AS (SELECT *, freq / (SELECT sum(freq) FROM f) AS prob, ln(freq) - ln((SELECT sum(freq) FROM f)) AS lp FROM f),
sn AS (SELECT word, c, sum(c) OVER (PARTITION BY word) AS s FROM (SELECT x.word AS word, x.next AS side, count(*) AS c FROM o WHERE x.next IS NOT NULL GROUP BY 1, 2)),
sp AS (SELECT word, c, sum(c) OVER (PARTITION BY word) AS s FROM (SELECT x.word AS word, x.prev AS side, count(*) AS c FROM o WHERE x.prev IS NOT NULL GROUP BY 1, 2)),
en AS (SELECT word, sum(-(c / s) * ln(c / s)) AS e FROM sn GROUP BY word), ep AS (SELECT word, sum(-(c / s) * ln(c / s)) AS e FROM sp GROUP BY word),
cut AS (SELECT word, lp, unnest(range(1, len)) AS k FROM p WHERE len > 1),
co AS (SELECT cut.word, min(cut.lp - a.lp - b.lp) AS cohesion FROM cut JOIN p a ON a.word = left(cut.word, cut.k::INT) JOIN p b ON b.word = substring(cut.word, cut.k + 1) GROUP BY cut.word),
r AS (SELECT word, len, freq, prob, lp AS log_prob, cohesion, coalesce(en.e, 0) AS suffix_entropy, coalesce(ep.e, 0) AS prefix_entropy
  FROM p LEFT JOIN co USING (word) LEFT JOIN en USING (word) LEFT JOIN ep USING (word) WHERE len >= 2)
"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.signals(_spread(table(spark, sf_dir, "conversations")), "text", 2, 3)


@query(_SIGNALS + """SELECT word, len, freq, round(prob, 9) AS prob, round(log_prob, 6) + 0.0 AS log_prob, round(cohesion, 6) + 0.0 AS cohesion,
round(suffix_entropy, 6) + 0.0 AS suffix_entropy, round(prefix_entropy, 6) + 0.0 AS prefix_entropy FROM r""")
def phrase_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _rounded(_signals(spark, sf_dir), "log_prob", "cohesion", "suffix_entropy", "prefix_entropy")
    return told.withColumn("prob", F.round("prob", 9))


_MARKS = "[" + "".join("\\" + c if c in "-\\.?*" else c for c in X.PUNCTUATION) + "]"


@query(_SIGNALS + f"""SELECT word, freq FROM r WHERE NOT regexp_matches(word, '{_MARKS}')
AND cohesion - 0.5 * log_prob > 4 AND suffix_entropy > 0.5 AND prefix_entropy > 0.5""")
def phrase_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = (F.col("cohesion") - 0.5 * F.col("log_prob") > 4) & (F.col("suffix_entropy") > 0.5) & (F.col("prefix_entropy") > 0.5)
    return phrases.candidates(_signals(spark, sf_dir)).where(strict).select("word", "freq")


@query(_SIGNALS + f"""SELECT word, freq FROM r WHERE NOT regexp_matches(word, '{_MARKS}') AND cohesion - 0.5 * log_prob > 9
AND sqrt(prefix_entropy * (suffix_entropy + 1)) - 0.85 * log_prob > 11 AND prefix_entropy > 0.5 AND suffix_entropy > 0 AND prefix_entropy + suffix_entropy > 3""")
def phrase_extract_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.extract(_spread(table(spark, sf_dir, "conversations")), "text", 2, 3).select("word", "freq")


# Suffix order and lookups
_SUFFIXES = """s AS (SELECT p_partkey, p - 1 AS pos, substring(p_name, p) AS suffix FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS p FROM part))"""


@query(f"""
WITH {_SUFFIXES}, r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY suffix) - 1 AS rank, lag(suffix) OVER (PARTITION BY p_partkey ORDER BY suffix) AS b FROM s)
SELECT p_partkey, rank, pos, coalesce(len(list_filter(range(1, least(length(suffix), length(b)) + 1), lambda i: left(suffix, i::INT) = left(b, i::INT))), 0) AS height FROM r""")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_array(_spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")), "p_partkey", "p_name")


@query("""
WITH t AS (SELECT p_partkey, repeat(p_name, 6) AS t FROM part), s AS (SELECT p_partkey, p - 1 AS pos, substring(t, p) AS suffix FROM (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS p FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY suffix) - 1 AS rank, lag(suffix) OVER (PARTITION BY p_partkey ORDER BY suffix) AS b FROM s)
SELECT p_partkey, rank, pos, coalesce(len(list_filter(range(1, least(length(suffix), length(b)) + 1), lambda i: left(suffix, i::INT) = left(b, i::INT))), 0) AS height FROM r""")
def suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose suffixes agree far beyond a key."""
    return suffix.suffix_array(_spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.repeat("p_name", 6).alias("t")), "p_partkey", "t")


@query(f"""
WITH {_SUFFIXES}, w(word) AS (VALUES ('a'), ('b'), ('re'), ('green'), ('zzz'))
SELECT word, p_partkey, count(*) FILTER (suffix < word) AS lower, count(*) FILTER (suffix < word) + count(*) FILTER (starts_with(suffix, word)) AS upper FROM s, w GROUP BY ALL""")
def prefix_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("a",), ("b",), ("re",), ("green",), ("zzz",)], "word string")
    return suffix.prefix_bounds(words, table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(f"""
WITH w AS (SELECT DISTINCT n_name AS word FROM nation UNION SELECT unnest(['the', 'ion', 'en', 'zzzz', 'èe'])),
g AS (SELECT word, count(*) AS c FROM ({_grams("conversations", "text", 2, 14)}) GROUP BY word)
SELECT word, coalesce(c, 0) AS cnt FROM w LEFT JOIN g USING (word)""")
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).union(spark.createDataFrame([("the",), ("ion",), ("en",), ("zzzz",), ("èe",)], "word string"))
    return ngrams.occurrence_counts(words, _spread(table(spark, sf_dir, "conversations")), "text")


@query(f"WITH g AS ({_grams('conversations', 'text', 2, 14)}) SELECT n_name AS word FROM nation WHERE n_name IN (SELECT word FROM g) UNION ALL SELECT * FROM (VALUES ('the'), ('ion')) v(word) WHERE word IN (SELECT word FROM g)")
def occurring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).union(spark.createDataFrame([("the",), ("ion",), ("zzzz",)], "word string"))
    return ngrams.occurring(words, _spread(table(spark, sf_dir, "conversations")), "text")


@query(f"""
WITH c AS (SELECT word, count(*) AS cnt FROM ({_grams("conversations", "text", 5, 5)}) GROUP BY word HAVING count(*) > 1)
SELECT cnt || chr(9) || word AS line FROM c WHERE NOT regexp_matches(word, '[\\r\\n]') UNION ALL SELECT 'Total Count: ' || coalesce(sum(cnt), 0)::BIGINT FROM c""")
def repeated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.repeated_listing(_spread(table(spark, sf_dir, "conversations")), "text", 5)


@query(f"""
WITH m AS ({PART_MODEL}), n AS (SELECT left(word, k::INT) AS node, CASE WHEN k = len THEN cnt ELSE 0 END AS cnt FROM (SELECT *, unnest(range(0, len + 1)) AS k FROM m))
SELECT node, length(node)::INT AS depth, sum(cnt)::BIGINT AS cnt FROM n GROUP BY node""")
def trie_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.trie_nodes(_part_model(spark, sf_dir))


@query("""
WITH t AS (SELECT p_name AS t FROM part), w AS (SELECT p - 1 AS pos, substring(t, greatest(1, p - 3), least(p, 4)) AS win FROM (SELECT t, unnest(range(1, length(t) + 1)) AS p FROM t))
SELECT pos::INT AS pos, win AS "window" FROM w""")
def reversed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.sorted_windows(table(spark, sf_dir, "part"), "p_name", 4, True)


@query(f"""
WITH {_SUFFIXES}, w(word) AS (VALUES ('a'), ('green'), ('e')), b AS (SELECT word, p_partkey, count(*) FILTER (suffix < word) AS lower, count(*) FILTER (starts_with(suffix, word)) AS cnt FROM s, w GROUP BY ALL)
SELECT p_partkey, word || ' ' || chr(9) || (lower + cnt) || ':' || lower || chr(9) || cnt AS reply FROM b""")
def bounds_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("a",), ("green",), ("e",)], "word string")
    return lookups.bounds_reply(suffix.prefix_bounds(words, table(spark, sf_dir, "part"), "p_partkey", "p_name")).select("p_partkey", "reply")


@query(f"""
WITH m AS ({PART_MODEL}), n AS (SELECT left(word, len - 1) AS word, cnt, sum(cnt) OVER (PARTITION BY left(word, len - 1)) AS s FROM m WHERE len > 1),
e AS (SELECT word, sum(-(cnt / s) * ln(cnt / s)) AS entropy FROM n GROUP BY word), w AS (SELECT DISTINCT left(p_type, 2) AS word FROM part UNION SELECT DISTINCT left(p_name, 2) FROM part)
SELECT word, coalesce(cnt, 0) AS cnt, round(coalesce(entropy, 0), 6) + 0.0 AS entropy FROM w LEFT JOIN m USING (word) LEFT JOIN e USING (word)""")
def describe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.select(F.left("p_type", F.lit(2)).alias("word")).union(part.select(F.left("p_name", F.lit(2)))).distinct()
    model = scratch.written(_part_model(spark, sf_dir), "catalog-model")
    return _rounded(lookups.describe(words, model, stats.next_char_entropy(model)), "entropy").drop("reply")


@query(f"""
WITH m AS ({DOC_MODEL}), w AS (SELECT DISTINCT left(word, 3) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part))
SELECT word, coalesce(cnt, 0) AS cnt FROM w LEFT JOIN m USING (word)""")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.left("w", F.lit(3)).alias("word")).distinct()
    return ngrams.counts_of(words, _documents_model(spark, sf_dir))


@query(f"""
WITH c AS MATERIALIZED (SELECT word, length(word) AS len, count(*) AS cnt FROM ({_short_grams("part", "p_name")}) GROUP BY word),
l AS (SELECT substring(word, 2) AS word, max(cnt) AS c FROM c WHERE len > 1 GROUP BY 1),
k AS MATERIALIZED (SELECT c.word, len, cnt FROM c LEFT JOIN l USING (word) WHERE coalesce(l.c, 0) < cnt),
t AS (SELECT word AS whole, cnt, right(word, n::INT) AS word FROM (SELECT word, cnt, unnest(range(1, len)) AS n FROM k WHERE len > 1)),
p AS (SELECT whole, arg_max(word, k.len) AS word, any_value(t.cnt) AS cnt FROM t JOIN k USING (word) GROUP BY whole),
x AS (SELECT word, sum(cnt) AS taken FROM p GROUP BY word)
SELECT word, len::INT AS len, cnt, (cnt - coalesce(taken, 0))::BIGINT AS freq FROM k LEFT JOIN x USING (word) ORDER BY freq DESC, word LIMIT 20""")
def substring_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.top_residual(suffix.substring_classes(table(spark, sf_dir, "part"), "p_name"), 20)


@query("SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::INT AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0)")
def char_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.char_index(_spread(table(spark, sf_dir, "documents").select("text")), "text")


# Cleaning
@query(r"""
SELECT doc_id, regexp_replace(text, '[^\p{L}]+', ' ', 'g') AS spaced, regexp_replace(text, '[^\p{L}]+', '', 'g') AS removed,
  regexp_replace(text, '[\p{Cc}\p{Zs}]+', '', 'g') AS plain, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_cjk FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.preprocess(t, "space", X.LETTERS).alias("spaced"), X.preprocess(t, "remove", X.LETTERS).alias("removed"), X.drop_controls(t).alias("plain"),
        X.class_length(t, X.LETTERS).alias("n_letters"), X.has_class(t).alias("has_cjk"),
    )


@query(r"""
WITH l AS (SELECT page_id::VARCHAR || ':' || (page_id * 7) || ':' || url AS line FROM pages UNION ALL SELECT 'plain ' || page_id FROM pages),
t AS (SELECT CASE WHEN regexp_matches(line, '^[^:]*:[^:]*:') THEN regexp_extract(line, '^[^:]*:[^:]*:(.*)$', 1) ELSE line END AS title FROM l)
SELECT title FROM t WHERE title NOT IN (SELECT 'plain ' || page_id FROM pages WHERE page_id % 2 = 0)""")
def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = pages.select(F.concat_ws(":", "page_id", F.col("page_id") * 7, "url").alias("v")).union(pages.select(F.concat(F.lit("plain "), F.col("page_id").cast("string"))))
    black = pages.where("page_id % 2 = 0").select(F.concat(F.lit("plain "), F.col("page_id").cast("string")).alias("title"))
    return corpora.without_titles(lines.select(X.index_title(F.col("v")).alias("title")), black)


@query("SELECT p_partkey, 'https://zh.wikipedia.org/zh-tw/' || url_encode(replace(p_name, ' ', '_')) AS url FROM part")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.page_url(F.col("p_name")).alias("url"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text || ' [1] [a 9] [ab] []', '[ \n\r]+', ' ', 'g'), '\[[\p{L}\p{Nd}]\s*\p{Nd}*\]', '', 'g') AS text FROM conversations""")
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit(" [1] [a 9] [ab] []"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.drop_citations(X.collapse_blanks(marked)).alias("text"))


@query("""
SELECT p_partkey, substring(p_name, 2) AS after, left(p_name, length(p_name) - 1) AS before, strlen(p_name) >= 20 AS long,
  CASE WHEN instr(p_name, 're') > 0 THEN strlen(left(p_name, instr(p_name, 're') - 1)) END AS at,
  CASE WHEN reverse(p_name) < reverse(p_type) THEN -1 WHEN reverse(p_name) > reverse(p_type) THEN 1 ELSE 0 END AS reversed FROM part""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.move_right(n).alias("after"), X.move_left(n).alias("before"), X.not_shorter_than(n, 20).alias("long"),
        X.byte_position(n, F.lit("re")).cast("long").alias("at"), X.reverse_compare(n, F.col("p_type")).alias("reversed"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H-%M-%S.') || lpad((extract(microseconds FROM ts) % 1000000)::VARCHAR, 6, '0') || '0' AS stamp FROM events")
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.stamp(F.col("ts")).alias("stamp"))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' new', ' ')) AS word FROM part), c AS (SELECT p_partkey, word, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS gone FROM part), d AS (SELECT c.p_partkey, word, n - CASE WHEN word = gone THEN 1 ELSE 0 END AS n FROM c JOIN l USING (p_partkey))
SELECT p_partkey, string_agg(word || '=' || n, ',' ORDER BY word) AS bag FROM d WHERE n > 0 GROUP BY p_partkey""")
def multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    bag = F.aggregate(words, F.create_map().cast("map<string,bigint>"), lambda m, w: X.multiset_add(m, w))
    told = X.multiset_remove(X.multiset_add(bag, F.lit("new")), words[0])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(told)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", listed.alias("bag"))


def _pages_sql() -> str:
    """The tables' pages are plain: one article, one kind of rejected element in it, no formula, no section ids, no stray end tags."""
    sub = lambda text, pattern, to: f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    marked = f"replace({sub(sub('html', '(?s)<script.*?</script>', chr(39) * 2), '(</p>|<br|</li>|</div>|</dt>|</dd>)', 'chr(1) || ' + chr(39) + chr(92) + '1' + chr(39))}, '<', ' <')"
    inner = f"regexp_extract({marked}, '(?s) <article>(.*?)(?:</article>|$)', 1)"
    for gone in ("(?s)<!--.*?-->", "(?s)<h1>.*?</h1>", "(?s)<table.*?</table>", "<[^>]*>"):
        inner = sub(inner, gone, "''")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        inner = f"replace({inner}, '&{name};', '{sign}')"
    tidy = f"replace({sub(sub(inner, '[ \\n\\r]+', chr(39) + ' ' + chr(39)), '\\[[\\p{L}\\p{Nd}]\\s*\\p{Nd}*\\]', chr(39) * 2)}, chr(1), chr(10))"
    lines = f"array_to_string(list_transform(string_split({tidy}, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), chr(10))"
    return f"SELECT page_id, url, {sub(lines, '\\n{2,}', 'chr(10)')} AS text, false AS cut_off, 0 AS extra_end_tags, NULL AS extract_error FROM pages"


@query(_pages_sql())
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), "html", html.GENERIC).drop("html")


# Dictionaries
_ENTRIES = "e AS (SELECT p_partkey AS line, p_brand || ' ' || p_size AS key, string_split(p_name, ' ') AS vals FROM part)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.concat_ws(" ", "p_brand", "p_size").alias("key"), F.split("p_name", " ").alias("values"))


@query(f"WITH {_ENTRIES} SELECT key, array_to_string(arg_max(vals, line), ' ') AS vals FROM e GROUP BY key")
def merge_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.merge(_entries(spark, sf_dir)).select("key", F.array_join("values", " ").alias("vals"))


@query(f"""
WITH {_ENTRIES}, x AS (SELECT line, key, unnest(vals) AS value FROM e), y AS (SELECT value, key, min(line) AS o FROM x GROUP BY value, key)
SELECT value AS key, string_agg(key, '|' ORDER BY o, key) AS vals FROM y GROUP BY value""")
def reverse_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.reverse(_entries(spark, sf_dir)).select("key", F.array_join("values", "|").alias("vals"))


@query(f"WITH {_ENTRIES}, x AS (SELECT key, unnest(vals) AS value FROM e) SELECT key, value FROM x WHERE contains(value, 're')")
def find_dictionary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.find_values(_entries(spark, sf_dir), "re")


_LEXICON = """l AS (SELECT DISTINCT 0 AS dict, left(p_name, 4) AS key, 'short ' || left(p_name, 4) AS v FROM part UNION ALL SELECT DISTINCT 1, left(p_name, 4), 'again' FROM part UNION ALL SELECT DISTINCT 1, left(p_name, 9), 'long ' || left(p_name, 9) FROM part)"""


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    head = lambda n, v: part.select(F.left("p_name", F.lit(n)).alias("key")).distinct().select("key", F.array(v).alias("values"))
    return dictionaries.group_lexicon([head(4, F.concat(F.lit("short "), "key")), head(4, F.lit("again")).unionByName(head(9, F.concat(F.lit("long "), "key")))])


@query(f"""
WITH {_LEXICON}, t AS (SELECT DISTINCT p_name AS text FROM part), h AS (SELECT text, len, left(text, len::INT) AS key FROM (SELECT text, unnest(range(1, length(text) + 1)) AS len FROM t))
SELECT text, len::INT AS len, key, arg_min(v, dict) AS value, min(dict) AS dict FROM h JOIN l USING (key) GROUP BY ALL""")
def all_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_name").distinct()
    return dictionaries.prefix_matches(texts, "p_name", _lexicon(spark, sf_dir)).select("text", "len", "key", F.col("values")[0].alias("value"), "dict")


@query(f"""
WITH {_LEXICON}, t AS (SELECT DISTINCT p_name AS text FROM part)
SELECT text, arg_min(key, dict * 1000 - length(key)) AS key, arg_min(v, dict * 1000 - length(key)) AS value FROM t JOIN l ON starts_with(text, key) GROUP BY text""")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_name").distinct()
    return dictionaries.longest_prefix(texts, "p_name", _lexicon(spark, sf_dir)).select("text", "key", F.col("values")[0].alias("value"))


def _converter(spark: SparkSession, sf_dir: str) -> convert.Converter:
    """A dictionary of the nations' names: phrases first, single letters in a second step."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    phrases_ = {n[:4]: [n[:4].lower()] for n in names}
    return convert.Converter([phrases_], [[phrases_, {"A": ["4"], "I": ["1"]}], [{"a": ["@"]}]])


_WALK = """
WITH RECURSIVE keys AS (SELECT DISTINCT left(n_name, 4) AS key FROM nation), t AS (SELECT DISTINCT {text} AS t FROM {source}),
walk AS (SELECT t, t AS rest, '' AS loose, '' AS out FROM t UNION ALL SELECT t,
  CASE WHEN key IS NULL THEN substring(rest, 2) ELSE substring(rest, 5) END, CASE WHEN key IS NULL THEN loose || left(rest, 1) ELSE '' END,
  CASE WHEN key IS NULL THEN out ELSE out || {flush} || {hit} END FROM walk LEFT JOIN keys ON key = left(rest, 4) WHERE rest <> ''),
done AS (SELECT t, out || {flush} AS out FROM walk WHERE rest = '')
"""


@query(_WALK.format(text="n_name", source="nation", flush="CASE WHEN loose = '' THEN '' ELSE loose || '/' END", hit="key || '/'") + "SELECT n_nationkey, rtrim(out, '/') AS words FROM nation JOIN done ON n_name = t")
def maxmatch_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _converter(spark, sf_dir)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(convert.segments(spark, F.col("n_name"), own), "/").alias("words"))


@query(_WALK.format(text="upper(c_mktsegment)", source="customer", flush="translate(loose, 'AI', '41')", hit="lower(key)") + "SELECT c_custkey, replace(out, 'a', '@') AS text FROM customer JOIN done ON upper(c_mktsegment) = t")
def convert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _converter(spark, sf_dir)
    return table(spark, sf_dir, "customer").select("c_custkey", convert.convert(spark, F.upper("c_mktsegment"), own).alias("text"))


@query(f"WITH {_LEXICON}, f AS (SELECT key, arg_min(v, dict) AS v FROM l GROUP BY key) SELECT p_partkey, left(p_name, 9) AS word, v AS value FROM part LEFT JOIN f ON key = left(p_name, 9)")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", F.left("p_name", F.lit(9)).alias("word"))
    return dictionaries.lookup(asked, _lexicon(spark, sf_dir)).select("p_partkey", "word", F.col("values")[0].alias("value"))


# Scores, segmentation, training
_BASE = "(SELECT sum(length(regexp_replace(p_name, '[^\\p{L}]+', '', 'g'))) FROM part)::DOUBLE"


def _scored(spark: SparkSession, sf_dir: str, names: list[str], custom: dict[str, str] | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part")
    model = _part_model(spark, sf_dir)
    base = part.agg(F.sum(X.class_length(F.col("p_name"), X.LETTERS))).first()[0]
    asked = model.select("word").union(part.select(F.concat(F.left("p_type", F.lit(3)), F.lit("q")).alias("word")))
    return S.score_table(asked, model, stats.model_length_stats(model), stats.next_char_entropy(model), float(base), names, custom)


_SCORED = f"""
WITH m AS ({PART_MODEL}),
st AS (SELECT len, avg(cnt) AS mean, stddev_pop(cnt) AS sd, sum(sqrt(cnt)) AS sq, sum(ln(cnt)) AS lg FROM m GROUP BY len),
en0 AS (SELECT left(word, len - 1) AS word, cnt, sum(cnt) OVER (PARTITION BY left(word, len - 1)) AS s FROM m WHERE len > 1),
en AS (SELECT word, sum(-(cnt / s) * ln(cnt / s)) AS e FROM en0 GROUP BY word),
a AS (SELECT word FROM m UNION SELECT left(p_type, 3) || 'q' FROM part),
t AS (SELECT a.word, length(a.word)::INT AS len, coalesce(cnt, 0) AS cnt, mean, sd, sq, lg, coalesce(e, 0) AS e, {_BASE} AS n
  FROM a LEFT JOIN m USING (word) LEFT JOIN st ON st.len = length(a.word) LEFT JOIN en ON en.word = a.word),
"""
_FINITE = "CASE WHEN isinf({0}) THEN -1e9 ELSE round({0}, 6) + 0.0 END"


@query(_SCORED + """
u AS (SELECT *, CASE WHEN cnt > 0 THEN ln(cnt / (n - len + 1)) ELSE -1e9 END AS "CdL", CASE WHEN cnt > 0 THEN ln(cnt / mean) ELSE -1e9 END AS "CdM",
  CASE WHEN sd > 0 THEN (cnt - mean) / sd ELSE 0 END AS dev, CASE WHEN cnt > 0 THEN ln(sqrt(cnt) / (sq / (n / mean))) ELSE -1e9 END AS "sqCdS",
  CASE WHEN cnt > 1 THEN ln(greatest(4.94e-324, ln(cnt) / (lg / (n / mean)))) ELSE ln(4.94e-324) END AS "lnCdS" FROM t)
SELECT word, len, cnt, round("CdL", 6) + 0.0 AS "CdL", round("CdM", 6) + 0.0 AS "CdM", CASE WHEN cnt > 0 THEN round("CdM" * len, 6) + 0.0 ELSE -1e9 END AS "CxLdM", round(dev, 6) + 0.0 AS "CmMdSTDE",
  round("sqCdS", 6) + 0.0 AS "sqCdS", CASE WHEN cnt > 0 THEN round("sqCdS" * len, 6) + 0.0 ELSE -1e9 END AS "sqCxLdS", round("lnCdS", 6) + 0.0 AS "lnCdS", round("lnCdS" * len, 6) + 0.0 AS "lnCxLdS",
  round(len / (1 + exp(-dev)), 6) + 0.0 AS "Sigmoid", round(e, 6) + 0.0 AS "Entropy", round(e * len, 6) + 0.0 AS "Entropy_L" FROM u""")
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [s for s in S.SCORES if s != "Hank"]
    told = _scored(spark, sf_dir, names)
    finite = {s: F.when(F.col(s) == float("-inf"), F.lit(-1e9)).otherwise(_r(s)) for s in names}
    return told.withColumns(finite)


def _hank_sql() -> str:
    c = lambda a, k: f"coalesce(m[substring(word, {a}, {k})], 0)::DOUBLE"
    q = lambda x, y: f"(CASE WHEN {c(*y)} > 0 THEN {c(*x)} / {c(*y)} ELSE 0 END)"
    free = lambda n: " * ".join(f"({c(a, 1)} / n)" for a in range(1, n + 1))
    chain = lambda n, o: " * ".join([f"({c(1, 1)} / n)", *(q((s := max(1, e - o), e - s + 1), (s, e - s)) for e in range(2, n + 1))])
    h = f"CASE len WHEN 1 THEN cnt / n WHEN 2 THEN {free(2)} + cnt / n WHEN 3 THEN {free(3)} + {chain(3, 1)} + 0.05 * cnt / n WHEN 4 THEN {free(4)} + {chain(4, 1)} + 0.05 * {chain(4, 2)} + 0.0001 * cnt / n ELSE 0 END"
    return _SCORED + f"mm AS (SELECT map(list(word), list(cnt)) AS m FROM m) SELECT word, len, cnt, round(ln(greatest({h}, 1e-300)), 6) + 0.0 AS \"Hank\" FROM t, mm"


@query(_hank_sql())
def hank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir, ["Hank"]), "Hank")


@query(_SCORED + "u AS (SELECT *, len * cnt / (mean + 1) + e AS score FROM t) SELECT word, len, cnt, round(score, 6) + 0.0 AS score FROM u")
def custom_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir, [], {"score": "L * C / (M + 1) + E"}), "score")


_DOC_CHUNKS = "SELECT chunk, count(*) AS times FROM (SELECT unnest(string_split_regex(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), '[ \\r\\n]')) AS chunk FROM documents) WHERE chunk <> '' GROUP BY chunk"
_PART_CHUNKS = "SELECT chunk, count(*) AS times FROM (SELECT unnest(string_split(p_name, ' ')) AS chunk FROM part) WHERE chunk <> '' GROUP BY chunk"


def _segmented(spark: SparkSession, sf_dir: str, score: str, expression: str | None = None) -> DataFrame:
    texts = _spread(table(spark, sf_dir, "documents").select("text"))
    letters = F.regexp_replace("text", "[^\\p{L}]+", " ")
    counted = scratch.written(texts.select(F.explode(X.chunks(letters)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("times")), "catalog-chunks")
    base = counted.agg(F.coalesce(F.sum(F.length("chunk") * F.col("times")), F.lit(0))).first()[0]
    model = scratch.written(_part_model(spark, sf_dir), "catalog-model")
    return segment.segment(counted, train.scored_words(model, counted, float(base), score, expression))


def _cut(chunks: str, value: str, tail: str) -> str:
    return R.segmented(chunks, PART_MODEL, value) + tail


_WORDS = " SELECT chunk, times, words FROM ck JOIN seg USING (chunk)"


@query(_cut(_DOC_CHUNKS, R.SIGMOID, _WORDS))
def segment_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "Sigmoid").select("chunk", "times", segment.joined(F.col("words")).alias("words"))


@query(_cut(_DOC_CHUNKS, "ln(cnt + 1) * len - 1", _WORDS))
def segment_dp_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "custom", "ln(C + 1) * L - 1").select("chunk", "times", segment.joined(F.col("words")).alias("words"))


@query(_cut(_DOC_CHUNKS, R.CXLDM, " SELECT count(*) AS n_words, sum(length(word))::BIGINT AS n_chars FROM (SELECT unnest(string_split(words, ' ')) AS word FROM seg)"))
def segmented_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.identified(segment.word_rows(_segmented(spark, sf_dir, "CxLdM")))


@query(f"""
WITH m AS ({PART_MODEL}), t AS (SELECT a.word, a.cnt, coalesce(b.cnt, 0) AS head FROM m a LEFT JOIN m b ON b.word = left(a.word, 1))
SELECT word, round(ln(1 + cnt / (1 + head)) * length(word), 6) + 0.0 AS score FROM t""")
def count_function_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that calls the count of another text."""
    model = scratch.written(_part_model(spark, sf_dir), "catalog-model")
    return _rounded(S.count_scores(model, model, 1.0, "ln(1 + C(S) / (1 + C(left(S, 1)))) * length(S)"), "score")


@query(R.trained(_PART_CHUNKS, PART_MODEL, 2, 0.5))
def train_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.iterate(_part_model(spark, sf_dir), table(spark, sf_dir, "part").select("p_name"), "p_name", 2, 0.5, char_class=X.LETTERS)


# Vectors
_INTS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::BIGINT) AS a, list_transform(list_reverse(embedding), lambda x: round(x * 50)::BIGINT) AS b FROM embeddings)"


def _ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    whole = lambda c, k: F.transform(c, lambda x: F.round(x * F.lit(k).cast("float")).cast("bigint"))
    return e.select("vec_id", whole(F.col("embedding"), 100).alias("a"), whole(F.reverse("embedding"), 50).alias("b"))


@query(f"WITH {_INTS} SELECT vec_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] + b[i]), ',') AS added, array_to_string(list_transform(a, lambda x: x + 1), ',') AS raised, a = b AS same FROM v")
def vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    v = _ints(spark, sf_dir)
    return v.select("vec_id", text(vectors.add(F.col("a"), F.col("b"))).alias("added"), text(vectors.increment(F.col("a"))).alias("raised"), vectors.equal(F.col("a"), F.col("b")).alias("same"))


@query(f"""
WITH {_INTS}, x AS (SELECT vec_id, unnest(range(1, len(a) + 1)) AS i, a, b FROM v), y AS (SELECT vec_id, i, unnest(range(1, len(b) + 1)) AS j, a, b FROM x)
SELECT vec_id, (i + j - 2)::INT AS k, sum(a[i] * b[j])::BIGINT AS value FROM y GROUP BY ALL""")
def convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ints(spark, sf_dir).select("vec_id", F.posexplode(vectors.convolve(F.col("a"), F.col("b"))).alias("k", "value"))
