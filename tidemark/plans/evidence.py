"""Queries over events, pages, documents and embeddings: flow shape, hosts, markup, families and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import markup, net
from tidemark.functions.roles import DOMAINS, classify_host, pattern
from tidemark.operators import candidates, families, vectors
from tidemark.plans.mapping import HOUR, P, packets, rounded, table
from tidemark.storage import materialize

QUERIES, ORACLES = {}, {}
STEP, POST, PRE, GAP = 96 * HOUR, 48 * HOUR, 96 * HOUR, 6 * HOUR
IMPORTANT, BACKEND = ["click", "signup", "purchase"], ["purchase"]


def query(sql: str, base: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = base + sql
        return f
    return add


_SEG = f"""WITH {P}, u AS (SELECT capture_id, min(ts) AS t0, max(ts) AS t1 FROM p GROUP BY 1), gr AS (SELECT capture_id, t0, unnest(range(0, floor((t1 - t0) / {STEP})::BIGINT + 1)) AS cand FROM u),
o AS (SELECT p.*, cand, t0 + cand * {STEP} AS at_, CASE WHEN ts - t0 >= cand * {STEP} THEN 'post' ELSE 'pre' END AS side, (CASE WHEN payload_len > 0 THEN payload_len ELSE length END)::DOUBLE AS size FROM p JOIN gr USING (capture_id) WHERE (ts - t0 >= cand * {STEP} AND ts - t0 < cand * {STEP} + {POST}) OR (ts - t0 < cand * {STEP} AND ts - t0 >= cand * {STEP} - {PRE})),
l AS (SELECT *, ln(1 + size) AS ll, ts - lag(ts) OVER w AS iat, lag(direction) OVER w AS bf FROM o WINDOW w AS (PARTITION BY capture_id, cand, flow_id, side ORDER BY ts, event_id)),
l2 AS (SELECT *, sum(CASE WHEN iat > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, cand, flow_id, side ORDER BY ts, event_id) AS br FROM l),
bu AS (SELECT capture_id, cand, flow_id, side, count(*) AS bursts, max(z) AS mb FROM (SELECT capture_id, cand, flow_id, side, br, sum(length) AS z FROM l2 GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT capture_id, cand, flow_id, side, greatest(coalesce(quantile_cont(iat, 0.5) FILTER (iat > 1e-6), 1.0), 1e-6) AS sc FROM l2 GROUP BY ALL),
st AS (SELECT capture_id, cand, flow_id, side, count(*) AS n_pkts, sum(size) AS bytes_total, max(ts) - min(ts) AS duration_s, count(*) FILTER (direction = 'up') / count(*) AS up_pkt_frac, coalesce(sum(size) FILTER (direction = 'up'), 0) / sum(size) AS up_byte_frac,
  count(*) FILTER (bf <> direction) / greatest(count(*) - 1, 1) AS dir_switch_rate, count(*) FILTER (bf = 'up' AND direction = 'down') / greatest(count(*) - 1, 1) AS up_then_down_rate, count(*) FILTER (size >= 1000) / count(*) AS large_pkt_frac, count(*) FILTER (size <= 80) / count(*) AS small_pkt_frac,
  avg(ll) AS len_log_mean, stddev_pop(ll) AS len_log_std, quantile_cont(ll, 0.9) AS len_log_p90, coalesce(quantile_cont(CASE WHEN iat IS NOT NULL THEN least(iat / sc, 30) END, 0.5), 0) AS iat_rel_p50, coalesce(quantile_cont(CASE WHEN iat IS NOT NULL THEN least(iat / sc, 30) END, 0.9), 0) AS iat_rel_p90
  FROM l2 JOIN sc USING (capture_id, cand, flow_id, side) GROUP BY ALL),
se AS (SELECT *, ln(1 + n_pkts) AS n_pkts_log, ln(1 + bytes_total) AS bytes_log, ln(1 + duration_s) AS duration_log, ln(1 + bursts) AS burst_count_log, ln(1 + mb) AS burst_bytes_max_log FROM st JOIN bu USING (capture_id, cand, flow_id, side)),
si AS (SELECT *, least(greatest((0.25::DOUBLE * least(1, bytes_log / ln(20001)) + 0.20::DOUBLE * least(1, n_pkts_log / ln(19)) + 0.25::DOUBLE * least(1, burst_bytes_max_log / ln(16001)) + 0.15::DOUBLE * (1 - abs(up_byte_frac - 0.5) * 2) + 0.15::DOUBLE * least(1, 0.5 * dir_switch_rate + 0.5 * up_then_down_rate)) * least(1, bytes_total / 900), 0), 1) AS intrinsic_salience FROM se)"""
_STATS = ["n_pkts_log", "bytes_total", "bytes_log", "duration_s", "duration_log", "up_pkt_frac", "up_byte_frac", "dir_switch_rate", "up_then_down_rate", "large_pkt_frac", "small_pkt_frac", "len_log_mean", "len_log_std", "len_log_p90", "iat_rel_p50", "iat_rel_p90", "burst_count_log", "burst_bytes_max_log", "intrinsic_salience"]


@query(_SEG + " SELECT capture_id, cand, flow_id, side, n_pkts, " + ", ".join(f"round({c}, 5)::DOUBLE AS {c}" for c in _STATS) + " FROM si")
def segment_stats(spark, sf_dir):
    rows = candidates.on_grid(packets(spark, sf_dir), STEP, POST, PRE)
    return rounded(candidates.segment_stats(rows, ["capture_id", "cand", "flow_id", "side"], GAP), 5)


_DIST = " + ".join(f"pow((po.{n} - pe.{n}) / {s}, 2)" for n, s in candidates.SCALES.items())
_SHAPE = _SEG + f""", fl AS (SELECT po.capture_id, po.cand, po.flow_id, pe.side IS NOT NULL AS had_pre, coalesce(least(greatest(sqrt(({_DIST}) / 16), 0), 3) / 3, po.intrinsic_salience) AS change, po.intrinsic_salience AS intrinsic, po.bytes_total AS bytes FROM (SELECT * FROM si WHERE side = 'post') po LEFT JOIN (SELECT * FROM si WHERE side = 'pre') pe USING (capture_id, cand, flow_id)),
f2 AS (SELECT *, least(greatest(0.55::DOUBLE * change + 0.45::DOUBLE * intrinsic, 0), 1) AS salience, greatest(1, bytes) AS w FROM fl),
fs AS (SELECT capture_id, cand, sum(salience * w) / sum(w) AS salience, list_avg(list_sort(list(salience), 'DESC')[1:3]) AS top3, max(change) AS change_max, sum(change * w) / sum(w) AS change, max(intrinsic) AS intrinsic_max, sum(intrinsic * w) / sum(w) AS intrinsic,
  coalesce(sum(bytes) FILTER (change >= 0.18 OR intrinsic >= 0.35), 0) / sum(bytes) AS changed_frac, coalesce(sum(bytes) FILTER (had_pre AND change < 0.08 AND intrinsic < 0.22), 0) / sum(bytes) AS stable_frac, count(*) AS active_flows, count(*) FILTER (salience >= 0.35) AS high_flows, count(*) FILTER (had_pre) / count(*) AS pre_frac FROM f2 GROUP BY ALL),
fm AS (SELECT *, least(high_flows / 3, 1) * least(greatest(top3, 0), 1) AS multiflow FROM fs)"""


@query(_SHAPE + " SELECT capture_id, cand, active_flows, high_flows, " + ", ".join(f"round({c}, 5)::DOUBLE AS {c}" for c in ("salience", "top3", "change_max", "change", "intrinsic_max", "intrinsic", "changed_frac", "stable_frac", "pre_frac", "multiflow")) + " FROM fm")
def flow_shape_change(spark, sf_dir):
    return rounded(candidates.flow_shape(packets(spark, sf_dir), STEP, POST, PRE, GAP), 5)


_W = candidates.WEIGHTS


@query(_SHAPE + f""", ff AS (SELECT capture_id, flow_id, min(ts) AS first_ts FROM p GROUP BY ALL),
ag AS (SELECT capture_id, cand, any_value(at_) AS ts, coalesce(sum(length) FILTER (side = 'post'), 0)::BIGINT AS bytes, coalesce(sum(length) FILTER (side = 'post' AND role IN ('click', 'signup', 'purchase')), 0)::BIGINT AS important, coalesce(sum(length) FILTER (side = 'post' AND role = 'purchase'), 0)::BIGINT AS backend,
  coalesce(sum(length) FILTER (side = 'pre' AND role IN ('click', 'signup', 'purchase')), 0)::BIGINT AS past, count(DISTINCT flow_id) FILTER (side = 'post' AND first_ts >= at_) AS new_flows FROM o JOIN ff USING (capture_id, flow_id) GROUP BY ALL HAVING coalesce(sum(length) FILTER (side = 'post'), 0) >= 20000)
SELECT capture_id, cand, round(ts, 5) AS ts, bytes, important, new_flows, {", ".join(f"round({c}, 5)::DOUBLE AS {c}" for c in ("salience", "top3", "change", "intrinsic", "multiflow", "stable_frac"))},
round({_W["salience"]}::DOUBLE * salience + {_W["top3"]}::DOUBLE * top3 + {_W["change"]}::DOUBLE * change + {_W["intrinsic"]}::DOUBLE * intrinsic + {_W["multiflow"]}::DOUBLE * multiflow + {_W["burst"]}::DOUBLE * least(greatest(ln(1 + important) / ln(50001), 0), 1.5) + {_W["backend"]}::DOUBLE * least(greatest(ln(1 + backend) / ln(50001), 0), 1.5)
 + {_W["quiet"]}::DOUBLE * least(greatest(1 - past / 20000, 0), 1) + {_W["new_flow"]}::DOUBLE * least(new_flows / 8, 1) - {_W["stable"]}::DOUBLE * stable_frac, 5)::DOUBLE AS score FROM ag JOIN fm USING (capture_id, cand)""")
def candidate_scan_score(spark, sf_dir):
    return rounded(candidates.scan_scores(packets(spark, sf_dir), STEP, POST, PRE, GAP, IMPORTANT, BACKEND, 20000), 5)


_HOST = "WITH h AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


@query(" SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h", _HOST)
def host_domains(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = net.host_from_url(F.col("url"))
    return p.select("page_id", host.alias("host"), net.registrable_domain(host).alias("domain"))


_TEST_HOSTS = ["api.infura.io", "cdn.jsdelivr.net", "login.foo.com", "shop.example.com", "s3.us-east-1.amazonaws.com", "bit.ly", "my.vercel.app", "www.google-analytics.com", "hooks.slack.com", "clients4.google.com", "other.net", ""]


@query(", t AS (SELECT page_id, ([" + ", ".join(map(repr, _TEST_HOSTS)) + f"])[page_id % {len(_TEST_HOSTS)} + 1] AS host FROM pages) SELECT page_id, CASE WHEN host = '' THEN 'unknown' " + " ".join(
    ("WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'first_party_site' " if r == "hosting_platform" else "") + f"WHEN regexp_matches(host, '{pattern(r)}') THEN '{r}'" for r in DOMAINS) + " ELSE 'third_party_backend_or_other' END AS role FROM t", _HOST)
def host_role_cascade(spark, sf_dir):
    hosts = F.array(*map(F.lit, _TEST_HOSTS))
    p = table(spark, sf_dir, "pages").withColumn("host", F.get(hosts, (F.col("page_id") % len(_TEST_HOSTS)).cast("int")))
    return p.select("page_id", classify_host(F.col("host"), F.lit("example.com")).alias("role"))


@query(r""", q AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN path = '' THEN '/' ELSE path END), '[a-f0-9]{32,64}', '{hex}', 'g'), '/\d{3,}(/|$)', '/{num}\1', 'g'), '/\d+(/|$)', '/{n}\1', 'g') AS path FROM h)
SELECT page_id, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(regexp_replace(path, '/{2,}', '/', 'g'), '/') END AS path FROM q""", _HOST)
def url_path_mask(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", net.mask_path(F.try_parse_url("url", F.lit("PATH"))).alias("path"))


@query(r""" SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, len(regexp_extract_all(html, '<script[^>]+src=["'']([^"'']+)["'']', 1, 'i'))::INT AS n_src,
substr(sha256(array_to_string(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)[1:1000], lambda x: lower(x)), ' ')), 1, 12) AS structure, len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)[1:1000])::INT AS n_tags FROM pages""")
def html_evidence(spark, sf_dir):
    h = F.col("html")
    tags = markup.tag_sequence(h)
    return table(spark, sf_dir, "pages").select("page_id", markup.title(h).alias("title"), F.size(markup.script_sources(h)).alias("n_src"), markup.short_hash(F.array_join(tags, " ")).alias("structure"), F.size(tags).alias("n_tags"))


@query("")
def html_visible_text(spark, sf_dir):
    h = F.col("html")
    scripts = F.transform(markup.inline_scripts(h), lambda s: markup.short_hash(markup.normalize_script(s), 16))
    return table(spark, sf_dir, "pages").select("page_id", markup.visible_text(h).alias("visible"), scripts.alias("script_hashes"))


_TOK = """WITH tk AS (SELECT DISTINCT source AS family, doc_id AS sample, t AS token FROM (SELECT source, doc_id, unnest(list_distinct(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'))) AS t FROM documents) WHERE length(t) >= 3)"""


def _samples(spark, sf_dir):
    """Each document's different words of three characters or more, as the inventory's body tokens; a family is a source."""
    text = F.lower("text")
    words = F.filter(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+")), lambda x: F.length(x) >= 3)
    some = text.rlike(r"[^\x20\x09-\x0D]{3}")
    return families.whole_samples(table(spark, sf_dir, "documents").select(F.col("source").alias("family"), F.col("doc_id").alias("sample"), words.alias("words"), some.alias("some")))


def _counts(spark, sf_dir):
    """The token counts and the sizes of the families."""
    samples = _samples(spark, sf_dir)
    return families.token_counts(samples), families.family_sizes(samples)


@query(" SELECT token, count(DISTINCT family) AS df FROM tk GROUP BY 1", _TOK)
def token_df(spark, sf_dir):
    return families.document_frequency(_counts(spark, sf_dir)[0])


@query(", s AS (SELECT family, count(DISTINCT sample) AS size FROM tk GROUP BY 1) SELECT family, token, count(DISTINCT sample) AS n, round(count(DISTINCT sample) / any_value(size), 6) AS coverage FROM tk JOIN s USING (family) GROUP BY 1, 2", _TOK)
def token_coverage(spark, sf_dir):
    return rounded(families.coverage(*_counts(spark, sf_dir)))


_RARE = _TOK + """, hd AS (SELECT DISTINCT family, token FROM tk), dq AS (SELECT token FROM hd GROUP BY 1 HAVING count(*) <= greatest(4, round((SELECT count(DISTINCT family) FROM hd) * 0.2))), ra AS (SELECT family, token FROM hd JOIN dq USING (token)),
sz AS (SELECT family, count(*) AS n FROM ra GROUP BY 1), pa AS (SELECT x.family AS a, y.family AS b, count(*) AS shared FROM ra x JOIN ra y ON x.token = y.token AND x.family < y.family GROUP BY ALL), pj AS (SELECT a, b, shared, shared / (s.n + t.n - shared) AS jaccard FROM pa JOIN sz s ON s.family = a JOIN sz t ON t.family = b)"""


@query(" SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM pj", _RARE)
def family_pair_jaccard(spark, sf_dir):
    return rounded(families.pair_overlap(families.rare_overlap(*_counts(spark, sf_dir), 0.2)))


@query(", e AS (SELECT a, b FROM pj WHERE jaccard >= 0.02 UNION SELECT b, a FROM pj WHERE jaccard >= 0.02), r AS (SELECT family AS f, family AS c FROM sz UNION SELECT r.f, e.b FROM r JOIN e ON r.c = e.a) SELECT f AS family, min(c) AS component FROM r GROUP BY 1", _RARE.replace("WITH", "WITH RECURSIVE", 1))
def family_components(spark, sf_dir):
    overlap = materialize(families.rare_overlap(*_counts(spark, sf_dir), 0.2), "overlap")
    return families.merge_families(families.pair_overlap(overlap).where("jaccard >= 0.02"), overlap.where("a <=> b").select(F.col("a").alias("family")))


@query(", s AS (SELECT family, count(DISTINCT sample) AS size FROM tk GROUP BY 1), c AS (SELECT family, token, count(DISTINCT sample) AS n, any_value(size) AS size, row_number() OVER (PARTITION BY family ORDER BY token) AS k FROM tk JOIN s USING (family) GROUP BY family, token), g AS (SELECT family, string_agg(token, chr(10) ORDER BY token) FILTER (n >= greatest(2, ceil(size * 0.5))) AS t, string_agg(token, chr(10) ORDER BY token) FILTER (k <= 20) AS u FROM c GROUP BY 1) SELECT family, 'family:' || substr(sha256(coalesce(t, u)), 1, 18) AS key FROM g", _TOK)
def family_key_hash(spark, sf_dir):
    return families.family_keys(*_counts(spark, sf_dir))


@query(" SELECT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def co_occurrence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return families.co_occurrence(e.select(F.col("user_id").alias("sample"), F.col("event_type").alias("key")))


@query(" SELECT DISTINCT ON (md5(text)) doc_id, source FROM documents ORDER BY md5(text), doc_id")
def dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("digest", F.md5(F.col("text").cast("binary")))
    return families.keep_first(d.select("digest", "doc_id", "source"), ["digest"], ["doc_id"]).select("doc_id", "source")


@query(", c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) SELECT source, lang, round(share, 6) AS share FROM r WHERE k = 1", "WITH z AS (SELECT 1)")
def family_majority(spark, sf_dir):
    return rounded(families.most_common(table(spark, sf_dir, "documents"), "source", "lang"))


_LONG = "WITH lf AS (SELECT vec_id AS id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _long(spark, sf_dir):
    return vectors.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query(", g AS (SELECT dim, label, count(*) AS n, sum(x) AS s FROM lf GROUP BY ALL), t AS (SELECT dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lf GROUP BY 1) SELECT dim::INT AS dim, round((sum(g.s * g.s / g.n) - any_value(t.s * t.s / t.n)) / any_value(t.q - t.s * t.s / t.n), 6) AS eta2 FROM g JOIN t USING (dim) GROUP BY dim", _LONG)
def eta_squared(spark, sf_dir):
    return rounded(vectors.eta_squared(_long(spark, sf_dir)))


@query(", g AS (SELECT dim, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM lf GROUP BY ALL), t AS (SELECT dim, avg(x) AS gm FROM lf GROUP BY 1) SELECT dim::INT AS dim, round(sum(n * pow(m - gm, 2)) / (sum(n * v) + 1e-12), 6) AS fisher FROM g JOIN t USING (dim) GROUP BY dim", _LONG)
def fisher_score(spark, sf_dir):
    return rounded(vectors.fisher_score(_long(spark, sf_dir)))


@query(", pm AS (SELECT label, dim, avg(x) AS m FROM lf GROUP BY ALL), d AS (SELECT id, pm.label, sqrt(sum(pow(x - m, 2))) AS d FROM lf JOIN pm USING (dim) GROUP BY ALL) SELECT id, arg_min(label, d) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY 1", _LONG)
def nearest_prototype(spark, sf_dir):
    return rounded(vectors.nearest_prototype(table(spark, sf_dir, "embeddings"), _long(spark, sf_dir), "vec_id", "embedding"))


@query(" SELECT q.vec_id AS id, round(list_sort(list(sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))))[10], 6) AS distance FROM embeddings q, (SELECT embedding FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 200) r GROUP BY 1")
def knn_gate(spark, sf_dir):
    """Distance to the 10th nearest of 200 references, drawn by hash from the whole table."""
    e = table(spark, sf_dir, "embeddings")
    drawn = e.withColumn("h", F.md5(F.col("vec_id").cast("string").cast("binary"))).orderBy("h", "vec_id").limit(200).drop("h")
    return rounded(vectors.kth_distance(e, drawn, "vec_id", "embedding", 10))


@query(" SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5)::INT AS fold FROM documents")
def stratified_folds(spark, sf_dir):
    return vectors.stratified_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5).select("doc_id", "fold")


@query(" SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS n, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), ())")
def coverage_audit(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    g = d.join(lab, "doc_id", "left").groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.count("has").alias("covered"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"))
    return g.select(F.when(F.col("gs") == 1, "*").otherwise(F.col("source")).alias("source"), F.when(F.col("gl") == 1, "*").otherwise(F.col("lang")).alias("lang"), "n", "covered", (F.col("n") - F.col("covered")).alias("missing"))


@query("""WITH r AS (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(l_linenumber, l_returnflag)) AS role FROM lineitem GROUP BY 1)
SELECT role, o_orderpriority AS priority, count(*) AS n, sum(l_quantity)::DOUBLE AS qty FROM lineitem JOIN r USING (l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def flow_role_join(spark, sf_dir):
    """Every row of a flow takes the role of the flow's last row; orders is the capture dimension."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    role = li.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("role"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return li.join(role, "l_orderkey").join(o, "l_orderkey").groupBy("role", "priority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
