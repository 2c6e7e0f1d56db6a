"""Secret scan: fixed patterns and a randomness test battery, as DataFrame expressions throughout.

Base spans come from three patterns. The method adds spans: maximal runs of token characters of 20 or more are given an
encoding (hex, letters of one case, base32, base36, base62, base64) by the smallest alphabet that holds them, and tested
over it: chi-squared uniformity of the characters, the number of runs above and below the alphabet's middle, and the lag-1
serial correlation. Three times the smallest p-value of "drawn uniformly" is the token's ``p``; below ``ALPHA`` it is
not taken for random, which keeps out sequences and repeats.

The statistic of uniformity is also held against text: the number of equal pairs among the characters is compared with
what words and names give at least (``ENCODINGS``), which yields the p-value ``p_text`` of "as repetitive as text". Over
these the Benjamini-Hochberg rule at level ``Q`` runs within each stratum of encoding and length class, so that of the
tokens that are reported about the share Q is text at most. A token is reported if it is rejected as text and not as
random. No length is set by hand: a short token's p_text is just larger. Alone in its stratum a random token is told from
text at about 20 characters of base62 or base64, 32 of base32 and 45 of one case; among many words it needs more.
P-values are counted in ``BINS`` logarithmic bins, so thresholds come from a table of fixed size whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.runtime import materialise, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+={{0,2}}"
#: Name, pattern, characters in order of value, and how far words and names in it stray from uniform:
#: sum((p - u)^2 / u) is about this at least, as letters of text repeat at a rate of 0.06.
ENCODINGS = (
    ("hex", "[0-9a-f]+", "0123456789abcdef", 1.0),
    ("HEX", "[0-9A-F]+", "0123456789ABCDEF", 1.0),
    ("lower", "[a-z]+", "abcdefghijklmnopqrstuvwxyz", 0.56),
    ("UPPER", "[A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.56),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.92),
    ("base36", "[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz", 1.16),
    ("BASE36", "[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.16),
    ("base62", "[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2.72),
    ("base64", "[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.84),
    ("base64url", "[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.84),
    ("mixed", "[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 2.96),
)
Q, ALPHA, BINS, BINS_PER_E = 0.05, 0.001, 400, 10
#: By how much the mean cube of text's character chances exceeds the square of their mean square, as a share of the latter.
TEXT_SPREAD = 0.3
_SPAN = "array<struct<lo:int,kind:int,hi:int,value:string>>"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(items: Column, kind: str, step) -> Column:
    """The array that ``step(at, item) -> (next at, added array)`` appends to, ``at`` an int from 0 on.

    Appending copies, so items go in blocks of about the square root of their number: no square of it is spent.
    """

    def within(s: Column, item: Column) -> Column:
        at, added = step(s["at"], item)
        return F.struct(at.alias("at"), F.concat(s["out"], added).alias("out"))

    def over(s: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(s["at"].alias("at"), F.array().cast(kind).alias("out")), within)
        return _bind(inner, lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    def blocks(m: Column) -> Column:
        side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(m))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(m) - 1, F.lit(0)) / side).cast("int")), lambda i: F.slice(m, i * side + 1, side))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), over, lambda s: F.flatten(s["out"]))

    return _bind(items, blocks)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, value: bool = False) -> Column:
    """Leftmost matches as structs (lo, kind, hi, value): code-point offsets from the pieces between matches."""
    marks = [F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    if group:
        marks.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    none = F.array().cast(_SPAN)

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        lo, part = at + m["gap"], m["part"] if group else m["hit"]
        hi = lo + F.length(m["hit"])
        one = F.array(F.struct(lo.alias("lo"), F.lit(kind).alias("kind"), hi.alias("hi"), (part if value else F.lit("")).alias("value")))
        return F.coalesce(hi, lo), F.when(m["hit"].isNotNull() & (F.length(part) >= least), one).otherwise(none)

    return F.when(text.rlike(pattern), _fold(F.arrays_zip(*marks), _SPAN, step)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed; text must not be null."""
    found = F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_MIN), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    return F.sort_array(F.transform(found, lambda s: F.struct(s["lo"].alias("lo"), s["kind"].alias("kind"), s["hi"].alias("hi"))))


def _normal_upper(z: Column) -> Column:
    """Upper tail of the normal law, by a rational fit of the error function good to 1e-7; tails by their expansion."""

    def tail(v: Column) -> Column:
        x = F.abs(v) / F.lit(2.0**0.5)
        near = _bind(1 / (1 + 0.3275911 * x), lambda t: 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x))
        far = F.exp(-v * v / 2) / (F.abs(v) * F.lit(2.5066282746310002))
        return _bind(F.when(F.abs(v) < 4, near).otherwise(far), lambda p: F.when(v >= 0, p).otherwise(1 - p))

    return _bind(z, tail)


def battery(token: Column) -> Column:
    """struct(encoding, size, chi, runs, serial, p, p_text) of one whole token of two characters or more."""
    number = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS, 1))):
        number = F.when(token.rlike(f"^(?:{pattern})$"), i).otherwise(number)
    column = lambda at, n: F.element_at(F.array(*(F.lit(e[at]) for e in ENCODINGS)), n)
    given = _bind(number, lambda n: F.struct(token.alias("token"), column(0, n).alias("encoding"), column(2, n).alias("letters"), column(3, n).alias("stray")))
    return _bind(given, _tests)


def _tests(g: Column) -> Column:
    token, m, n = g["token"], F.length(g["letters"]).cast("double"), F.length(g["token"]).cast("double")
    without = lambda text, part: F.length(text) - F.length(F.replace(text, F.lit(part) if isinstance(part, str) else part, F.lit("")))
    counts = F.transform(F.split(g["letters"], ""), lambda c: without(token, c).cast("double"))
    middle = F.floor((F.length(g["letters"]) + 1) / 2).cast("int")
    told = lambda text, letters, sign: F.call_function("translate", text, letters, F.lit(sign * 99))
    sides = told(told(token, F.left(g["letters"], middle), "\x01"), F.substring(g["letters"], middle + 1, F.lit(99)), "\x02")
    centre = (m - 1) / 2
    lag = F.aggregate(
        F.split(token, ""), F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: _bind(F.instr(g["letters"], c) - 1 - centre, lambda x: F.struct(x.alias("last"), (s["sum"] + F.coalesce(s["last"] * x, F.lit(0.0))).alias("sum"))), lambda s: s["sum"],
    )
    given = F.struct(
        g["encoding"].alias("encoding"), g["stray"].alias("stray"), m.alias("m"), n.alias("n"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1) / 2).alias("equal"),
        without(sides, "\x02").cast("double").alias("high"), (1 + (without(sides, "\x01\x02") + without(sides, "\x02\x01")) / 2).cast("double").alias("turns"), lag.alias("lag"),
    )
    return _bind(given, _p_values)


def _p_values(g: Column) -> Column:
    n, m, high, equal = g["n"], g["m"], g["high"], g["equal"]
    low, free = n - high, m - 1
    chi = 2 * m * equal / n + m - n
    # cube-root approximation of the chi-squared law
    root = (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    expected = 2 * high * low / n + 1
    var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    p_chi = _normal_upper(root)
    p_runs = F.when(var > 0, 2 * _normal_upper(F.abs((g["turns"] - expected) / F.sqrt(F.when(var > 0, var))))).otherwise(F.lit(0.0))
    p_serial = 2 * _normal_upper(F.abs(g["lag"] / (F.sqrt(n - 1) * (m * m - 1) / 12)))
    # equal pairs among text's characters: mean, and variance with the pairs that share a character
    rate, pairs = (g["stray"] + 1) / m, n * (n - 1) / 2
    apart = F.sqrt(pairs * rate * (1 - rate) + n * (n - 1) * (n - 2) * TEXT_SPREAD * rate * rate)
    p_text = _normal_upper((pairs * rate - equal - 0.5) / apart)
    told = F.struct(
        g["encoding"].alias("encoding"), n.cast("int").alias("size"), p_chi.alias("chi"), p_runs.alias("runs"), p_serial.alias("serial"),
        p_text.alias("p_text"),
    )
    return _bind(told, lambda t: t.withField("p", F.least(F.lit(1.0), 3 * F.least(t["chi"], t["runs"], t["serial"]))))


def _bin(p: Column) -> Column:
    """0 for p = 1, one more for each factor exp(-1 / BINS_PER_E)."""
    return F.when(p <= 0, F.lit(BINS)).otherwise(F.least(F.lit(BINS), F.floor(-F.ln(p) * BINS_PER_E).cast("int")))


def _stratum(encoding: Column, size: Column) -> Column:
    return F.concat_ws("/", encoding, F.floor(F.log2(size.cast("double"))).cast("string"))


def thresholds(tokens: DataFrame) -> DataFrame:
    """(stratum, cut) from rows (stratum, bin): bins of cut or more are no text by the step-up rule at level Q.

    A bin's upper p-value stands for all in it; a stratum in which nothing is rejected has no row. The table is at most
    encodings x length classes x BINS rows.
    """
    counts = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("n").over(w.orderBy(F.desc("bin"))).alias("rank"), F.sum("n").over(w).alias("total"))
    passed = ranked.where(F.exp(-F.col("bin") / F.lit(float(BINS_PER_E))) <= F.lit(Q) * F.col("rank") / F.col("total"))
    return passed.groupBy("stratum").agg(F.min("bin").alias("cut"))


def tested_runs(text: Column) -> Column:
    """Token runs of a text as structs (lo, hi, stratum, bin, uniform); uniform: the battery does not reject "random"."""

    def run(s: Column) -> Column:
        told = lambda t: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), _stratum(t["encoding"], t["size"]).alias("stratum"), _bin(t["p_text"]).alias("bin"), (t["p"] >= ALPHA).alias("uniform"))
        return _bind(battery(F.rtrim(s["value"], F.lit("="))), told)

    return F.transform(_spans(text, RUN, 3, 0, MIN_TOKEN, True), run)


def _reported(found: DataFrame, base: str, runs: str) -> Column:
    """The runs that are reported, as structs (lo, kind, hi): decided by thresholds over all rows of ``found``."""
    cuts = thresholds(found.where(F.size(runs) > 0).select(F.explode(runs).alias("r")).select("r.stratum", "r.bin"))
    rows = {r["stratum"]: r["cut"] for r in cuts.collect()}  # at most encodings x length classes
    table = F.create_map(*(F.lit(x) for kv in rows.items() for x in kv)) if rows else F.create_map().cast("map<string,int>")
    clear = lambda r: ~F.exists(base, lambda b: (b["lo"] < r["hi"]) & (r["lo"] < b["hi"]))
    random = F.filter(runs, lambda r: r["uniform"] & (r["bin"] >= F.coalesce(F.try_element_at(table, r["stratum"]), F.lit(BINS + 1))) & clear(r))
    return F.transform(random, lambda r: F.struct(r["lo"].alias("lo"), F.lit(3).alias("kind"), r["hi"].alias("hi")))


def scan(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``base``, ``added``: arrays of (lo, kind, hi), kind the index in KINDS.

    Null texts count as empty and have no spans; rows repeat as they come; an empty table gives no rows. A random span
    that meets a base span is left out. Only spans and p-values are written between the two passes, no texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found, _ = materialise(docs.select(*id_cols, base_spans(text).alias("base"), tested_runs(text).alias("runs")), "secret-spans")
    return found.select(*id_cols, "base", _reported(found, "base", "runs").alias("added"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["lo"], s["hi"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, [id_col], text_col).select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, each secret span (overlapping ones merged) replaced by ``mark``.

    A length column, where there is one, follows changed texts. Rows are written once with their spans beside them, so
    each text is searched and tested once; thresholds and the replacing read that table.
    """
    base, runs, new = (unused(docs, c) for c in ("_base", "_runs", "_clean"))
    text = F.col(text_col)
    own = F.coalesce(text, F.lit(""))
    found, _ = materialise(docs.select("*", base_spans(own).alias(base), tested_runs(own).alias(runs)), "secret-texts")
    spans = _merged(F.sort_array(F.concat(F.col(base), _reported(found, base, runs))))
    changed = found.withColumn(new, F.when(F.size(base) + F.size(runs) > 0, _bind(spans, lambda m: _replaced(text, m, mark))).otherwise(text))
    if length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(F.size(base) + F.size(runs) == 0, F.col(length_col)).when(F.col(new) != text, F.length(new).cast("long")).otherwise(F.col(length_col)))
    return changed.withColumn(text_col, F.col(new)).select(*docs.columns)


def _merged(spans: Column) -> Column:
    """Structs (lo, hi) of sorted spans, without what an earlier one covers."""
    kind = "array<struct<lo:int,hi:int,on:boolean>>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        fresh = F.array(F.struct(F.greatest(at, x["lo"]).alias("lo"), x["hi"].alias("hi"), (x["lo"] < at).alias("on")))
        return F.greatest(at, x["hi"]), F.when(x["hi"] > at, fresh).otherwise(F.array().cast(kind))

    return _fold(spans, kind, step)


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for each span; one that goes on from the span before adds no mark.

    The text is cut into as many stretches as the root of the spans' number, and each stretch by its spans, since a
    substring costs the way to its start.
    """
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(spans))).cast("int"))
    end = lambda i: F.when(i > 0, F.get(spans, F.least(i * side, F.size(spans)) - 1)["hi"]).otherwise(F.lit(0))

    def stretch(i: Column) -> Column:
        given = F.struct(F.slice(spans, i * side + 1, side).alias("own"), end(i).alias("at"), F.substring(text, end(i) + 1, end(i + 1) - end(i)).alias("part"))

        def pieces(g: Column) -> Column:
            before = lambda j: F.when(j > 0, F.get(g["own"], j - 1)["hi"]).otherwise(g["at"])
            return F.array_join(F.transform(g["own"], lambda x, j: F.concat(F.substring(g["part"], before(j) - g["at"] + 1, x["lo"] - before(j)), F.when(x["on"], F.lit("")).otherwise(F.lit(mark)))), "")

        return _bind(given, pieces)

    many = F.ceil(F.size(spans) / side).cast("int")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), many - 1), stretch), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(whole, F.substring(text, end(many) + 1, F.lit(2147483647))))
