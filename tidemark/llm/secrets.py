"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans are the strong patterns: ``assign``, ``access`` and ``hex``. Where a
text also holds an access identifier or a user, weak candidates are looked for
too: ``key`` (a long mixed-case token), ``user`` (a named user or a mail
address) and ``endpoint`` (a URL, or an IPv4 address with or without a port).
Parts are interval-joined within SCOPE code points, and a weak candidate is
reported only when the parts that complement it are there: a key beside an
identifier (access or user), a user beside a secret (assign, hex or key), an
endpoint beside an identifier and a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize

SCOPE = 200
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")


def _either(word: str) -> str:
    """A pattern of a word in either case, ASCII letters only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: group 2 is the value, which has 6 characters or more
ASSIGN = f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')}){_VALUE}([A-Za-z0-9+/_.=-]+)"
#: maximal runs: of 20 characters or more, and of 24 or more
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KEY = "[A-Za-z0-9+/]{32,}"
USER = f"({'|'.join(map(_either, ('username', 'user', 'login', 'account', 'client_id')))}){_VALUE}([A-Za-z0-9._@+-]{{3,}})|[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(\\.[A-Za-z0-9-]{{1,63}})+"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?"""
MASK = "[SECRET]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(a: Column) -> Column:
    """Running sums of an array of longs, the element itself included.

    Sums of runs of about the square root of the length first, then within
    them, so that an array of a million takes a billion steps at most.
    """
    def add(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def of(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")

        def runs(w: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda b: F.slice(x, b * w + 1, w))
            return _let(parts, lambda p: _let(F.transform(p, add), lambda t: F.flatten(F.transform(p, lambda run, b: _let(add(F.slice(t, F.lit(1), b)), lambda before: F.transform(run, lambda v, i: before + add(F.slice(run, F.lit(1), i + 1))))))))

        return _let(width, runs)

    return F.when(F.size(a) > 0, of(a)).otherwise(F.array().cast("array<bigint>"))


def find_spans(text: Column, pattern: str, kind: int, might: Column, value_group: int = 0, least: int = 0, keep=None) -> Column:
    """Spans struct(s, k, e) in code points of the leftmost non-overlapping matches, in order.

    The texts between matches and the matches give the places. might: a cheap
    test without which nothing is searched. Matches whose group is shorter
    than least, or for which keep is false, are dropped after matching.
    """
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")

    def spans(x: Column) -> Column:
        found, between, value = x["m"], x["b"], x["v"]
        steps = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long"))
        rows = _let(prefix_sums(steps), lambda at: F.transform(at, lambda s, i: F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(F.get(found, i))).alias("e"), F.get(value, i).alias("v"))))
        good = F.filter(rows, lambda r: (F.length(r["v"]) >= least) & (keep(r["v"]) if keep else F.lit(True)))
        return F.transform(good, lambda r: F.struct(r["s"].alias("s"), r["k"].alias("k"), r["e"].alias("e")))

    matched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"))
    return F.when(might & text.rlike(pattern), _let(matched, spans)).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _mixed_case(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, weak): arrays of spans by start, weak ones only where a text has an identifier."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    signed = t.contains("=") | t.contains(":")
    rows = rows.select(
        "doc_id", "text", find_spans(t, ASSIGN, 0, signed, 2, 6).alias("assign"), find_spans(t, ACCESS, 1, t.contains("AKIA")).alias("access"),
        find_spans(t, HEX, 2, F.lit(True)).alias("hex"), find_spans(t, USER, 4, signed | t.contains("@")).alias("user"),
    )
    named = (F.size("access") > 0) | (F.size("user") > 0)
    return rows.select(
        "doc_id", "assign", "access", "hex",
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.array_sort(F.concat("user", find_spans(t, KEY, 3, named, 0, 0, _mixed_case), find_spans(t, ENDPOINT, 5, named & (t.contains("://") | t.contains("."))))).alias("weak"),
    ).select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), "base", "weak")


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, tag, linked): the weak spans to report, by document and a hash of its parts.

    An interval join: each part lies in the scope-wide cells it reaches to,
    so a task compares only parts of one cell of one document. Rows with the
    same id and parts are alike and joined once.
    """
    few = found.where(F.size("weak") > 0).select("doc_id", F.xxhash64("base", "weak").alias("tag"), "base", "weak").dropDuplicates(["doc_id", "tag"])
    cell = lambda p: F.floor(p / scope)
    weak = few.select("doc_id", "tag", F.explode("weak").alias("w")).select("doc_id", "tag", "w", F.explode(F.sequence(cell(F.col("w.s")), cell(F.col("w.e")))).alias("cell"))
    near = few.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.explode(F.concat("base", "weak")).alias("p")).select("d", "t", "p", F.explode(F.sequence(cell(F.col("p.s") - scope), cell(F.col("p.e") + scope))).alias("c"))
    met = weak.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")) & (F.col("cell") == F.col("c")) & (F.col("p.s") <= F.col("w.e") + scope) & (F.col("w.s") <= F.col("p.e") + scope))
    kind = F.col("p.k")
    roles = met.groupBy("doc_id", "tag", "w").agg(F.bool_or(kind.isin(1, 4)).alias("identifier"), F.bool_or(kind.isin(0, 2, 3)).alias("secret"))
    whole = ((F.col("w.k") == 3) & F.col("identifier")) | ((F.col("w.k") == 4) & F.col("secret")) | ((F.col("w.k") == 5) & F.col("identifier") & F.col("secret"))
    return roles.where(whole).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list("w")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, linked) of each row; spans are struct(s, k, e), k an index of KINDS.

    Whole texts are searched. A null text is an empty one, a null id is kept;
    repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result. Documents without weak candidates are not
    shuffled.
    """
    found = materialize(parts(docs, id_col, text_col), "secret-parts")
    none = F.array().cast(found.schema["base"].dataType)
    plain = found.where(F.size("weak") == 0).withColumn("linked", none).drop("weak")
    more = linked_parts(found).withColumnsRenamed({"doc_id": "d", "tag": "t"})
    some = found.where(F.size("weak") > 0).withColumn("tag", F.xxhash64("base", "weak")).drop("weak")
    joined = some.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left").drop("d", "t", "tag").withColumn("linked", F.coalesce("linked", none))
    return plain.unionByName(joined)


def _without(text: Column, spans: Column) -> Column:
    """text with MASK in place of each run of overlapping spans; spans by start."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, x: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], between, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    return F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _base_masked(t: Column) -> Column:
    """Base matches masked kind by kind, in the order assign, access, hex, each in the text as masked so far; linear in the text."""
    def assigns(x: Column) -> Column:
        masked = F.zip_with(F.transform(x["m"], lambda m, i: F.when(F.length(F.get(x["v"], i)) >= 6, F.lit(MASK)).otherwise(m)), F.slice(x["b"], 2, F.size(x["m"])), lambda m, b: F.concat(m, b))
        return F.concat(F.get(x["b"], F.lit(0)), F.array_join(masked, ""))

    matched = F.struct(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)).alias("m"), F.split(t, ASSIGN, -1).alias("b"), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)).alias("v"))
    base = F.when((t.contains("=") | t.contains(":")) & t.rlike(ASSIGN), _let(matched, assigns)).otherwise(t)
    base = F.when(base.contains("AKIA"), F.regexp_replace(base, ACCESS, MASK)).otherwise(base)
    return F.when(t.rlike(HEX), F.regexp_replace(base, HEX, MASK)).otherwise(base)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with secrets masked: every base match, and the reported weak spans.

    A text with linked spans is cut by position: base and linked spans of the
    original text, overlapping ones as one. Other texts are masked kind by
    kind. Texts without a secret stay as they are, null ones too; chars_col,
    where there is one, follows the text. Null ids, repeated rows and rows
    that share an id are masked by their own text's spans. Documents without
    an identifier are masked in the scan; only the others, which could have a
    weak candidate reported, are shuffled. An empty table gives an empty
    result. Columns are those of docs.
    """
    t = F.col(text_col)
    might = F.coalesce((t.contains("AKIA") & t.rlike(ACCESS)) | ((t.contains("=") | t.contains(":") | t.contains("@")) & t.rlike(USER)), F.lit(False))

    # spans are positions in one text: rows that share an id, or have none, keep their own
    keyed = docs.where(might).withColumn("__key", F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(t, 256)))
    found = materialize(parts(keyed, "__key", text_col).where(F.size("weak") > 0), "secret-weak")
    more = linked_parts(found).select(F.col("doc_id").alias("__id"), "linked")
    bases = found.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("__b"), "base")
    spans = more.dropDuplicates(["__id"]).join(bases, F.col("__id") == F.col("__b")).select("__id", F.array_sort(F.concat("base", "linked")).alias("__spans"))
    linked = keyed.join(spans, F.col("__key") == F.col("__id"), "left")
    some = linked.withColumn("__text", F.when(F.col("__spans").isNotNull(), _without(t, F.col("__spans"))).otherwise(_base_masked(t)))
    out = docs.where(~might).withColumn("__text", _base_masked(t)).unionByName(some.drop("__key", "__id", "__spans"))
    chars = {chars_col: F.when(F.col("__text") == t, F.col(chars_col)).otherwise(F.length("__text").cast("long")).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {}
    changed = {c: F.coalesce(e, F.col(c)) for c, e in chars.items()} | {text_col: F.col("__text")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def op3_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "linked"))).alias("spans"))


def _found_sql(kind: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS k, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b, regexp_extract_all(text, '{p}', {group}) AS v FROM t WHERE regexp_matches(text, '{p}') AND {keep}"""


OP3_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
named AS (SELECT rid FROM t WHERE regexp_matches(text, '{ACCESS}') OR regexp_matches(text, '{USER.replace("'", "''")}')),
found AS (
  {_found_sql(0, ASSIGN, 2, "TRUE")} UNION ALL {_found_sql(1, ACCESS, 0, "TRUE")} UNION ALL {_found_sql(2, HEX, 0, "TRUE")}
  UNION ALL {_found_sql(4, USER, 0, "TRUE")} UNION ALL {_found_sql(3, KEY, 0, "rid IN (SELECT rid FROM named)")} UNION ALL {_found_sql(5, ENDPOINT, 0, "rid IN (SELECT rid FROM named)")}
), each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found
), spans AS (
  SELECT rid, k, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n
  FROM each WHERE (k <> 0 OR length(v[i]) >= 6) AND (k <> 3 OR (regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[0-9]')))
), parts AS (SELECT rid, k, s, s + n AS e FROM spans),
roles AS (
  SELECT w.rid, w.k, w.s, w.e, bool_or(p.k IN (1, 4)) AS identifier, bool_or(p.k IN (0, 2, 3)) AS secret
  FROM parts w JOIN parts p ON w.rid = p.rid AND p.s <= w.e + {SCOPE} AND w.s <= p.e + {SCOPE} WHERE w.k > 2 GROUP BY ALL
), kept AS (
  SELECT rid, k, s, e FROM parts WHERE k < 3 UNION ALL
  SELECT rid, k, s, e FROM roles WHERE (k = 3 AND identifier) OR (k = 4 AND secret) OR (k = 5 AND identifier AND secret)
), written AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(([{", ".join(repr(k) for k in KINDS)}])[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(([{", ".join(repr(k) for k in KINDS)}])[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN written USING (rid)
"""
