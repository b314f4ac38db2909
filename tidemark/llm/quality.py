"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are
compared with those of every language of the corpus by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). The nearest language counts.
Documents below the minimum lengths are not judged by the histogram that their
length cannot fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAK, WORD_CHAR = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Character classes that patterns take out of a text; what is left is the class of all others.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:!?'\"()\-", "mark": r"#*$%&|<>@~\^_=+/\\{}\[\]`"}
COMMON_WORDS, COMMON_LETTERS = 40, 5
#: Labels with a reference of their own.
MOST_REFERENCES = 128
MIN_CHARS, MIN_WORDS = 120, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.8


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def class_counts(text: Column) -> Column:
    """Counts of the classes in code points, as listed, all others last, as doubles.

    Classes are taken out one after another, the commonest first, so only the
    first pattern reads the whole text.
    """
    order = sorted(CLASSES, key=["lower", "space", "upper", "stop", "digit", "mark"].index)
    start = F.struct(text.alias("t"), F.array().cast("array<double>").alias("n"))

    def take(state: Column, name: str) -> Column:
        return _let(state, lambda s: _let(F.regexp_replace(s["t"], f"[{CLASSES[name]}]+", ""), lambda rest: F.struct(rest.alias("t"), F.concat(s["n"], F.array((F.length(s["t"]) - F.length(rest)).cast("double"))).alias("n"))))

    state = start
    for name in order:
        state = take(state, name)
    return _let(state, lambda s: F.concat(F.array(*[F.get(s["n"], F.lit(order.index(c))) for c in CLASSES]), F.array(F.length(s["t"]).cast("double"))))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice, the first included.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts
    with a repeated window sort theirs.
    """
    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(F.transform(p, lambda x, k: F.when(((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == x["h"])), x["i"])), lambda x: x.isNotNull())
            return _let(F.sort_array(twice), lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return _let(pairs, again)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    counted = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _jsd_rest(p: Column, q: Column) -> Column:
    """What a bin with p > 0 adds to twice the divergence beyond q, its part if p were 0."""
    return p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0) - q


def distances(items: Column, total: Column, refs: Column) -> Column:
    """Least Jensen-Shannon distance from a histogram to the references, 1 if there is none.

    items: array of (count, shares in each reference) for the bins with counts;
    total: their sum; refs: the sum of each reference's shares, 0 or 1. A
    reference whose shares sum to 0 counts as 1 away.
    """
    def least(bound: Column) -> Column:
        def one(sum_: Column, k: Column) -> Column:
            rest = F.aggregate(bound["items"], F.lit(0.0), lambda s, x: s + _jsd_rest(x["c"] / bound["total"], F.get(x["q"], k)))
            return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rest + sum_) / 2)))

        return F.array_min(F.transform(refs, one))

    # items and total are bound once, not for each reference
    return F.coalesce(F.least(_let(F.struct(items.alias("items"), total.alias("total")), least), F.lit(1.0)), F.lit(1.0))


def _short_words(text: Column) -> Column:
    return F.filter(F.transform(words_of(text), F.lower), lambda w: (F.octet_length(w) <= 2 * COMMON_LETTERS) & (F.length(w) <= COMMON_LETTERS) & w.rlike(r"^\p{L}+$"))


def language(docs: DataFrame, lang_col: str = "lang") -> Column:
    """The label a document counts under: its own if it is one of the MOST_REFERENCES labels of most documents, else null."""
    top = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(MOST_REFERENCES + 1).collect()
    if len(top) <= MOST_REFERENCES:
        return F.col(lang_col)
    return F.when(F.col(lang_col).isin([r.lang for r in top[:MOST_REFERENCES]]), F.col(lang_col))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """For each language its class shares and its COMMON_WORDS most frequent words of up to COMMON_LETTERS letters with shares.

    Counted over all documents; a language is a label of language(), null
    among them. What reaches the driver is MOST_REFERENCES + 1 rows at most,
    and COMMON_WORDS words for each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(language(docs, lang_col).alias("lang"), text.alias("text"))
    width = len(CLASSES) + 1
    sums = rows.select("lang", class_counts(F.col("text")).alias("c")).groupBy("lang").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(width)]).collect()
    counts = rows.select("lang", F.explode(_short_words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    most = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    top = counts.withColumn("place", F.row_number().over(most)).where(F.col("place") <= COMMON_WORDS).collect()
    out = []
    for r in sorted(sums, key=lambda r: (r.lang is None, r.lang or "")):
        classes = [float(r[f"c{i}"] or 0) for i in range(width)]
        words = {t.word: float(t["count"]) for t in sorted(top, key=lambda t: t.place) if t.lang == r.lang}
        share = lambda xs: [x / sum(xs) if sum(xs) else 0.0 for x in xs]
        out.append({"lang": r.lang, "classes": share(classes), "words": dict(zip(words, share(list(words.values()))))})
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with the base counts, both distances, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. kept: not base_failed, and neither distance to the nearest
    language's reference is above its limit; a distance is null, and judges
    nothing, below MIN_CHARS code points or MIN_WORDS words, and where no word
    is a common one the word distance is 1. References are one row of arrays,
    of bounded size, that every document meets in a broadcast; with more than
    MOST_REFERENCES labels the documents of the rarer ones make one reference
    together. Nulls: a null text has no words, a null lang is a language, a
    null id passes through. Repeated rows are rows of their own; other columns
    are ignored. An empty table gives an empty result.
    """
    refs = references(docs, text_col, lang_col)
    vocabulary = sorted({w for r in refs for w in r["words"]})
    held = docs.sparkSession.createDataFrame(
        [(1, [[r["classes"][i] for r in refs] for i in range(len(CLASSES) + 1)], [float(sum(r["classes"]) > 0) for r in refs], {w: [r["words"].get(w, 0.0) for r in refs] for w in vocabulary}, [float(len(r["words"]) > 0) for r in refs])],
        "one int, class_refs array<array<double>>, class_sums array<double>, shares map<string, array<double>>, word_sums array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lit(1).alias("one")).join(F.broadcast(held), "one")
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("classes", class_counts(F.col("text")))
    class_items = F.filter(F.transform("classes", lambda c, i: F.struct(c.alias("c"), F.get("class_refs", i).alias("q"))), lambda x: x["c"] > 0)
    n_chars = F.aggregate("classes", F.lit(0.0), lambda s, x: s + x)
    class_distance = F.when(n_chars >= MIN_CHARS, distances(class_items, n_chars, F.col("class_sums")))
    common = F.sort_array(F.filter(F.transform("words", F.lower), lambda w: w.isin(vocabulary) if vocabulary else F.lit(False)))
    heads = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda x: x.isNotNull())
    word_items = _let(common, lambda s: _let(heads(s), lambda h: F.transform(h, lambda i, k: F.struct((F.coalesce(F.get(h, k + 1), F.size(s)) - i).cast("double").alias("c"), F.element_at("shares", F.get(s, i)).alias("q")))))
    rows = rows.withColumn("items", word_items).withColumn("n_common", F.aggregate("items", F.lit(0.0), lambda s, x: s + x["c"]))
    some = F.when(F.col("n_common") > 0, distances(F.col("items"), F.col("n_common"), F.col("word_sums"))).otherwise(1.0)
    word_distance = F.when((F.size("words") >= MIN_WORDS) & F.lit(bool(vocabulary)), some)
    counted = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        (n_chars - F.get("classes", F.lit(list(CLASSES).index("space")))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"), n_repeat_words(F.col("words")).alias("n_repeat_words"),
        class_distance.alias("class_distance"), word_distance.alias("word_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def op5_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _jsd_sql(p: str, q: str) -> str:
    return f"{p} * log2(2 * {p} / ({p} + {q})) + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END - {q}"


def _op5_sql() -> str:
    names = list(CLASSES)
    each = ", ".join("length(regexp_replace(text, '[^{}]+', '', 'g'))::DOUBLE".format(CLASSES[c].replace("'", "''")) for c in names)
    other = "length(regexp_replace(text, '[{}]+', '', 'g'))::DOUBLE".format("".join(CLASSES.values()).replace("'", "''"))
    return f"""
WITH lk AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {MOST_REFERENCES}),
t AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IN (SELECT lang FROM lk) THEN lang END AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_CHAR}') AS w FROM documents),
f AS (SELECT *, [{each}, {other}] AS c, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD_CHAR}')) AS lines, list_transform(w, lambda x: lower(x)) AS lw FROM t),
win AS (SELECT rid, i, w[i:i + {WINDOW - 1}] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY 1),
cb AS (SELECT rid, lang, unnest(range(1, {len(names) + 2})) AS b, unnest(c) AS n FROM f),
cr AS (SELECT lang, b, sum(n) / nullif(sum(sum(n)) OVER (PARTITION BY lang), 0) AS q FROM cb GROUP BY lang, b),
ct AS (SELECT rid, sum(n) AS total FROM cb GROUP BY 1),
cd AS (SELECT rid, least(1, min(d)) AS d FROM (
  SELECT x.rid, r.lang, sqrt(greatest(0, least(1, (sum({_jsd_sql("(x.n / total)", "coalesce(r.q, 0)")}) FILTER (x.n > 0) + any_value(s.q)) / 2))) AS d
  FROM cb x JOIN ct USING (rid) JOIN cr r ON r.b = x.b JOIN (SELECT lang, coalesce(sum(q), 0) AS q FROM cr GROUP BY 1) s ON s.lang IS NOT DISTINCT FROM r.lang WHERE total > 0 GROUP BY x.rid, r.lang) GROUP BY 1),
sw AS (SELECT rid, lang, unnest(lw) AS x FROM f),
wc AS (SELECT lang, x, count(*) AS n FROM sw WHERE length(x) <= {COMMON_LETTERS} AND strlen(x) <= {2 * COMMON_LETTERS} AND regexp_matches(x, '^\\p{{L}}+$') GROUP BY lang, x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) <= {COMMON_WORDS}),
wr AS (SELECT lang, x, n / sum(n) OVER (PARTITION BY lang) AS q FROM wc),
di AS (SELECT rid, x, count(*) AS n FROM sw WHERE x IN (SELECT x FROM wr) GROUP BY ALL),
dt AS (SELECT rid, sum(n) AS total FROM di GROUP BY 1),
lg AS (SELECT DISTINCT lang FROM f),
wd AS (SELECT rid, least(1, min(d)) AS d FROM (
  SELECT di.rid, lg.lang, sqrt(greatest(0, least(1, (sum({_jsd_sql("(di.n / total)", "coalesce(wr.q, 0)")}) + (lg.lang IS NOT DISTINCT FROM any_value(h.lang) AND any_value(h.has))::INT) / 2))) AS d
  FROM di JOIN dt USING (rid) CROSS JOIN lg LEFT JOIN wr ON wr.x = di.x AND wr.lang IS NOT DISTINCT FROM lg.lang LEFT JOIN (SELECT lang, TRUE AS has FROM wr GROUP BY 1) h ON h.lang IS NOT DISTINCT FROM lg.lang GROUP BY di.rid, lg.lang) GROUP BY 1),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, (list_sum(c) - c[{names.index("space") + 1}])::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  CASE WHEN length(text) >= {MIN_CHARS} THEN cd.d END AS class_d, CASE WHEN len(w) >= {MIN_WORDS} THEN coalesce(wd.d, 1.0) END AS word_d FROM f LEFT JOIN cov USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(class_d, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_d, 0) <= {MAX_WORD_DISTANCE} AS kept FROM v
"""


OP5_SQL = _op5_sql()
