"""The same results in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

from . import relations as R

S, SP, X, Q = R.SAMPLES, R.SPLIT, R.EXPOSURES, R.SEQUENCE
FROZEN = R.VALIDATION_START
LOG0 = "ln(1 + greatest(coalesce(CAST({} AS DOUBLE), 0), 0))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def log0(x: str) -> str:
    return LOG0.format(x)


POP = """
pop AS (SELECT s.*, round((coalesce(c, 0) + 10.0 * (SELECT avg(label) FROM split WHERE split = 'train')) / (coalesce(n, 0) + 10), 9) AS score
        FROM split s LEFT JOIN (SELECT item_id, sum(label) AS c, count(*) AS n FROM split WHERE split = 'train' GROUP BY item_id) t ON s.item_id = t.item_id)
"""
GROUPS = """
rk AS (SELECT split, group_id, label, rank() OVER (PARTITION BY group_id ORDER BY score) + (count(*) OVER (PARTITION BY group_id, score) - 1) / 2.0 AS a,
              row_number() OVER (PARTITION BY group_id ORDER BY score DESC, sample_id) AS r FROM pop WHERE split IN ('validation', 'test')),
gm AS (SELECT split, group_id, sum(label) AS p, count(*) AS n, sum(a) FILTER (label = 1) AS sa, avg(1.0 / r) FILTER (label = 1) AS mrr,
              sum(CASE WHEN label = 1 AND r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS d5, sum(CASE WHEN label = 1 AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS d10
       FROM rk GROUP BY split, group_id HAVING sum(label) > 0 AND sum(label) < count(*)),
ideal AS (SELECT p, k, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(p, k)) AS v FROM (SELECT DISTINCT p FROM gm) CROSS JOIN (VALUES (5), (10)) u(k))
"""
QSPLIT = """
qs AS (SELECT *, CASE WHEN "timestamp" < lo THEN 'train' WHEN "timestamp" < hi THEN 'validation' ELSE 'test' END AS split
       FROM {0} CROSS JOIN (SELECT quantile_cont("timestamp", 0.7) AS lo, quantile_cont("timestamp", 0.85) AS hi FROM {0}))
"""
XPOP = POP.replace("FROM split s", "FROM qs s").replace("FROM split WHERE", "FROM qs WHERE")


def _binary(source: str, keys: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(label) AS BIGINT) AS positives,
       round(CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(CASE WHEN label = 1 THEN a END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END, 6) AS auc,
       round(avg(-(label * ln(score) + (1 - label) * ln(1 - score))), 6) AS log_loss
FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {lead}score) - 1) / 2.0 AS a FROM {source}) {by}"""


def _cut(interval: int, delay: int, frozen: int | None = None) -> str:
    c = f'"timestamp" - "timestamp" % {interval} - {delay}'
    return f"least({c}, {frozen - delay})" if frozen is not None else c


def _interaction(frozen: int | None) -> str:
    return _with(S, f'p AS (SELECT sample_id, user_id, category, item_id, {_cut(R.INTERVAL, R.DELAY, frozen)} AS cut FROM samples)', "c AS (SELECT * FROM samples WHERE label = 1 AND policy <> 'random')") + f"""
SELECT p.sample_id, round({log0('sum(CASE WHEN c.category = p.category THEN 1 END)')}, 6) AS user_category_click_count_log,
       round(coalesce(sum(CASE WHEN c.category = p.category THEN 1 END) / CAST(nullif(count(c.sample_id), 0) AS DOUBLE), 0), 6) AS user_category_click_share,
       round(ln(1 + coalesce(greatest((p.cut - max(CASE WHEN c.category = p.category THEN c."timestamp" END)) / 3600000.0, 0), 720.0)), 6) AS user_category_recency_hours_log,
       round({log0('sum(CASE WHEN c.item_id = p.item_id THEN 1 END)')}, 6) AS user_item_click_count_log
FROM p LEFT JOIN c ON p.user_id = c.user_id AND c."timestamp" < p.cut GROUP BY p.sample_id, p.cut"""


def _relative(names: list[str], what: str) -> str:
    out = []
    for s in names:
        out.append(f"round({log0(s)}, 6) AS candidate_past_{what}_{s}_log")
        out.append(f"round(CASE WHEN sum({s}) OVER g > 0 THEN {s} / CAST(sum({s}) OVER g AS DOUBLE) ELSE 0 END, 6) AS candidate_past_{what}_{s}_ratio")
        out.append(f"round((rank() OVER (PARTITION BY group_id ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY group_id, {s}) - 1) / 2.0) / count(*) OVER g, 6) AS candidate_past_{what}_{s}_rank_pct")
    return ",\n       ".join(out)


def _scoped(source: str, value: str, widths: dict[str, int]) -> tuple[str, list[str]]:
    cols, names = [], []
    for scope, keys in (("global", "item_id"), ("user", "user_id, item_id")):
        for w, ms in {**widths, "all": None}.items():
            low = "UNBOUNDED PRECEDING" if ms is None else f"{ms - 1} PRECEDING"
            cols.append(f'coalesce(sum({value}) OVER (PARTITION BY {keys} ORDER BY "timestamp" RANGE BETWEEN {low} AND 1 PRECEDING), 0) AS {scope}_{w}')
            names.append(f"{scope}_{w}")
    return f"sc AS (SELECT sample_id, group_id, {', '.join(cols)} FROM {source})", names


def _exposure() -> str:
    part, names = _scoped("samples", "1", {k: R.ORDER_WIDTHS[k] for k in ("7d", "30d")})
    return _with(S, part) + f"SELECT sample_id, {_relative(names, 'exposure')} FROM sc WINDOW g AS (PARTITION BY group_id)"


def _engagement() -> str:
    v = "CASE WHEN scroll_percentage IS NOT NULL THEN CAST(round(greatest(coalesce(read_time, 0), 0) / greatest(candidate_count, 1) * 1000000) AS BIGINT) ELSE 0 END"
    part, names = _scoped("samples", v, {k: R.ORDER_WIDTHS[k] for k in ("7d", "30d")})
    scale = f"ss AS (SELECT sample_id, group_id, {', '.join(f'{n} / 1000000.0 AS {n}' for n in names)} FROM sc)"
    return _with(S, part, scale) + f"SELECT sample_id, {_relative(names, 'engagement')} FROM ss WINDOW g AS (PARTITION BY group_id)"


def _momentum() -> str:
    part, names = _scoped("exposures", "1", R.EVENT_WIDTHS)
    mom, out, ladder = [], [], list(R.EVENT_WIDTHS.items())
    for (a, x), (b, y) in zip(ladder, ladder[1:], strict=False):
        for scope in ("global", "user"):
            n = f"candidate_past_exposure_{scope}_{a}_{b}_momentum_log"
            mom.append(f"ln(1 + ({scope}_{a} + 1) / ({scope}_{b} / {y / x} + 1)) AS {n}")
            out += [f"round({n}, 6) AS {n}", f"round((rank() OVER (PARTITION BY group_id ORDER BY round({n}, 9) DESC) + (count(*) OVER (PARTITION BY group_id, round({n}, 9)) - 1) / 2.0) / count(*) OVER g, 6) AS {n}_rank_pct"]
    return _with(X, part, f"mo AS (SELECT *, {', '.join(mom)} FROM sc)") + f"SELECT sample_id, {_relative(names, 'exposure')}, {', '.join(out)} FROM mo WINDOW g AS (PARTITION BY group_id)"


def _session() -> str:
    a, b = R.ORDER_WIDTHS["30d"], R.ORDER_WIDTHS["90d"]
    seen = ", ".join(f"coalesce(CAST(since <= {k} AS INTEGER), 0) AS candidate_seen_previous_{k}" for k in (1, 2, 5, 10, 20))
    return _with(
        S,
        'rq AS (SELECT user_id, group_id, "timestamp" AS t, min(sample_id) AS f FROM samples GROUP BY ALL)',
        "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, f) AS seq FROM rq)",
        f"n AS (SELECT x.user_id, x.group_id, x.seq, count(y.seq) FILTER (y.t >= x.t - {a}) AS ns, count(y.seq) FILTER (y.t >= x.t - {b}) AS nl, (x.t - max(y.t)) / 60000.0 AS gap FROM o x LEFT JOIN o y ON x.user_id = y.user_id AND y.seq < x.seq GROUP BY x.user_id, x.group_id, x.seq, x.t)",
        "j AS (SELECT sample_id, ns, nl, gap, seq - lag(seq) OVER (PARTITION BY s.user_id, item_id ORDER BY seq, sample_id) AS since FROM samples s JOIN n ON s.user_id = n.user_id AND s.group_id = n.group_id)",
    ) + f"SELECT sample_id, round({log0('ns')}, 6) AS user_impression_count_1h_log, round({log0('nl')}, 6) AS user_impression_count_24h_log, round({log0('gap')}, 6) AS user_previous_impression_minutes_log, {seen} FROM j"


AGE = 'greatest(("timestamp" - pub_time * 1000) / 3600000.0, 0)'
LONG_TERM = _with(
    S, f'p AS (SELECT sample_id, user_id, {_cut(R.INTERVAL, R.DELAY)} AS cut FROM samples)',
    f'c AS (SELECT user_id, "timestamp" AS t, item_id, category, "timestamp" // 86400000 AS day, {AGE} AS age FROM samples WHERE label = 1 AND policy <> \'random\')',
    "a AS (SELECT sample_id, p.cut, count(c.t) AS n, count(DISTINCT day) AS d, count(DISTINCT item_id) AS i, count(DISTINCT category) AS k, avg(age) AS m, stddev_samp(age) AS sd, sum(CAST(age <= 24 AS INTEGER)) AS f, max(c.t) AS l FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.t < p.cut GROUP BY sample_id, p.cut)",
) + f"""SELECT sample_id, round({log0('n')}, 4) AS user_click_count_log, round({log0('d')}, 4) AS user_active_days_log, round({log0('i')}, 4) AS user_unique_items_log, round({log0('k')}, 4) AS user_unique_categories_log,
       round({log0('m')}, 4) AS user_consumed_age_mean_log, round({log0('CASE WHEN n > 1 THEN sd END')}, 4) AS user_consumed_age_std_log, round(CASE WHEN n > 0 THEN f / CAST(n AS DOUBLE) ELSE 0 END, 4) AS user_fresh_click_share,
       round(CASE WHEN n > 0 THEN 1 - i / CAST(n AS DOUBLE) ELSE 0 END, 4) AS user_repeat_click_share, round(coalesce(ln(1 + greatest((cut - l) / 3600000.0, 0)), 0), 4) AS user_last_click_recency_hours_log FROM a"""  # fmt: skip

HISTORY = _with(
    S, f"""h AS (SELECT user_id, list(item_id ORDER BY "timestamp", sample_id) AS h FROM samples WHERE "timestamp" < {FROZEN} AND label = 1 GROUP BY user_id)""",
    "u AS (SELECT user_id, len(h) AS n, unnest(h) AS item_id, generate_subscripts(h, 1) AS pos FROM h)",
    "i AS (SELECT user_id, item_id, count(*) AS c, max(n) - min(pos) + 1 AS off FROM u GROUP BY ALL)",
    "k AS (SELECT user_id, p_brand AS category, count(*) AS c FROM u JOIN part ON u.item_id = CAST(p_partkey AS VARCHAR) GROUP BY ALL)",
) + f"""SELECT sample_id, round({log0('len(h)')}, 6) AS user_fixed_history_length_log, round({log0('i.c')}, 6) AS candidate_fixed_history_count_log, round(coalesce(1.0 / off, 0), 6) AS candidate_fixed_history_recency_reciprocal,
       round({log0('k.c')}, 6) AS fixed_history_category_count_log, round(coalesce(k.c / CAST(greatest(len(h), 1) AS DOUBLE), 0), 6) AS fixed_history_category_share
FROM samples s LEFT JOIN h ON s.user_id = h.user_id LEFT JOIN i ON s.user_id = i.user_id AND s.item_id = i.item_id LEFT JOIN k ON s.user_id = k.user_id AND s.category = k.category"""  # fmt: skip

TOPIC = _with(
    S, f"p AS (SELECT sample_id, user_id, len(list_distinct(tags)) AS nt, {_cut(R.INTERVAL, R.DELAY)} AS cut, unnest(list_distinct(tags)) AS tag FROM samples)",
    """c AS (SELECT user_id, "timestamp" AS t, unnest(list_distinct(tags)) AS tag FROM samples WHERE label = 1 AND policy <> 'random')""",
    "j AS (SELECT sample_id, nt, p.tag, count(*) FILTER (c.tag = p.tag) AS pref, count(c.t) AS total FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.t < p.cut GROUP BY ALL)",
    "a AS (SELECT sample_id, sum(CAST(pref > 0 AS INTEGER)) AS o, max(nt) AS nt, sum(pref) AS pref, max(total) AS total FROM j GROUP BY sample_id)",
) + f"""SELECT sample_id, CAST(o AS BIGINT) AS user_topic_overlap_count, round(o / CAST(greatest(nt, 1) AS DOUBLE), 6) AS user_topic_overlap_ratio, round({log0('pref')}, 6) AS user_topic_click_count_log,
       round(CASE WHEN total > 0 THEN pref / CAST(total AS DOUBLE) ELSE 0 END, 6) AS user_topic_click_share FROM a"""  # fmt: skip

_Z = "greatest(-3.0, least(3.0, ({c} - (SELECT avg({c}) FROM split WHERE split = 'train')) / (SELECT CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END FROM split WHERE split = 'train')))"
CONTEXT = _with(S, SP) + f"""SELECT sample_id, round({_Z.format(c='position')}, 6) AS context_position, round({_Z.format(c='candidate_count')}, 6) AS context_candidate_count,
       round(position / CAST(greatest(candidate_count, 1) AS DOUBLE), 6) AS context_position_ratio,
       round(sin(2 * pi() * hour(epoch_ms("timestamp")) / 24), 6) AS context_hour_sin, round(cos(2 * pi() * hour(epoch_ms("timestamp")) / 24), 6) AS context_hour_cos,
       round(sin(2 * pi() * (isodow(epoch_ms("timestamp")) - 1) / 7), 6) AS context_weekday_sin, round(cos(2 * pi() * (isodow(epoch_ms("timestamp")) - 1) / 7), 6) AS context_weekday_cos,
       CAST(device_type = 'F' AS DOUBLE) AS "context_device_type_F", CAST(device_type = 'O' AS DOUBLE) AS "context_device_type_O" FROM split"""

EVENT_AGG = _with(X, f'p AS (SELECT sample_id, item_id, {_cut(3_600_000, 60_000)} AS cut FROM exposures)', "e AS (SELECT * FROM exposures WHERE policy <> 'random')") + """
SELECT p.sample_id, CAST(count(e.sample_id) AS BIGINT) AS event_count, CAST(coalesce(sum(e.label), 0) AS BIGINT) AS event_click_count, CAST(coalesce(sum(1 - e.label), 0) AS BIGINT) AS event_expose_count,
       count(DISTINCT e."timestamp" // 86400000) AS event_active_days, count(DISTINCT e.user_id) AS event_unique_partner_count,
       round(CASE WHEN count(e.sample_id) > 0 THEN sum(e.label) / CAST(count(e.sample_id) AS DOUBLE) ELSE 0 END, 6) AS event_click_rate, (p.cut - max(e."timestamp")) // 1000 AS event_recency_seconds,
""" + ", ".join(f'count(*) FILTER (e."timestamp" > p.cut - {ms}) AS event_count_{w}' for w, ms in R.EVENT_WIDTHS.items()) + """
FROM p LEFT JOIN e ON p.item_id = e.item_id AND e."timestamp" < p.cut GROUP BY p.sample_id, p.cut"""

RQ = """
rq AS (SELECT event_id AS query_id, session_id, user_id, item_id AS target, "timestamp",
              (SELECT list(item_id ORDER BY "timestamp", step, event_id) FROM (SELECT * FROM seq y WHERE y.session_id = x.session_id AND y."timestamp" < x."timestamp" ORDER BY "timestamp" DESC, step DESC, event_id DESC LIMIT 5)) AS history FROM seq x),
qq AS (SELECT * FROM rq WHERE len(history) > 0 AND NOT list_contains(history, target))
"""
TRAIN = "train AS (SELECT * FROM (" + "SELECT *, quantile_cont(\"timestamp\", 0.7) OVER () AS lo FROM seq) WHERE \"timestamp\" < lo)"
TESTQ = "tq AS MATERIALIZED (SELECT query_id, session_id, user_id, target, history FROM (SELECT *, quantile_cont(\"timestamp\", 0.85) OVER () AS hi FROM qq) WHERE \"timestamp\" >= hi)"
N_QUERIES = "(SELECT CAST(count(*) AS DOUBLE) FROM tq)"
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)"
HOT = 'hot AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score, row_number() OVER (ORDER BY count(*) DESC, item_id) AS "rank" FROM train GROUP BY item_id)'


def _icf(k: int) -> str:
    return f"""
lt AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item_id) AS n FROM (SELECT user_id, item_id, max("timestamp") AS t FROM train GROUP BY user_id, item_id)) WHERE n <= 200),
us AS (SELECT item_id, count(*) AS n FROM lt GROUP BY item_id),
nb AS (SELECT * FROM (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS "rank" FROM (
        SELECT a.item_id AS src, b.item_id AS dst, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS score FROM lt a JOIN lt b ON a.user_id = b.user_id AND a.item_id <> b.item_id
        JOIN us x ON x.item_id = a.item_id JOIN us y ON y.item_id = b.item_id GROUP BY ALL)) WHERE "rank" <= {k})
"""


def _i2i(k: int) -> str:
    return f"""
i2i AS (SELECT * FROM (SELECT query_id, item_id, score, {TOP} AS "rank" FROM (
         SELECT query_id, dst AS item_id, max(score) AS score FROM (SELECT query_id, history, unnest(list_distinct(history)) AS src FROM tq) t JOIN nb ON t.src = nb.src WHERE NOT list_contains(history, dst) GROUP BY ALL)) WHERE "rank" <= {k})
"""


BI = 'bi AS (SELECT src, dst, count(*) AS n FROM (SELECT item_id AS src, lead(item_id) OVER (PARTITION BY session_id ORDER BY "timestamp", step, event_id) AS dst FROM {}) WHERE dst IS NOT NULL GROUP BY ALL)'
TRANS = f"""
trn AS (SELECT * FROM (SELECT query_id, item_id, score, {TOP} AS "rank" FROM (
         SELECT query_id, dst AS item_id, round(max(ln(1 + n) / (nh - pos + 2)), 6) AS score FROM (SELECT query_id, history, len(history) AS nh, unnest(history) AS src, generate_subscripts(history, 1) AS pos FROM tq) t
         JOIN bi ON t.src = bi.src WHERE NOT list_contains(history, dst) GROUP BY ALL)) WHERE "rank" <= 20)
"""
BASE = (X, Q, TRAIN, RQ, TESTQ)
CHANNELS = (*BASE, HOT, _icf(20), _i2i(20), BI.format("train"), TRANS, 'hq AS (SELECT query_id, item_id, score, CAST("rank" AS INTEGER) AS "rank" FROM tq CROSS JOIN hot WHERE "rank" <= 20)')
POOL = (*CHANNELS, """pool AS MATERIALIZED (SELECT query_id, item_id, min("rank") FILTER (c = 'hot') AS rank_hot, min("rank") FILTER (c = 'i2i') AS rank_i2i, min("rank") FILTER (c = 'trn') AS rank_transition FROM (
  SELECT query_id, item_id, "rank", 'hot' AS c FROM hq UNION ALL SELECT query_id, item_id, "rank", 'i2i' FROM i2i UNION ALL SELECT query_id, item_id, "rank", 'trn' FROM trn) GROUP BY ALL),
po AS MATERIALIZED (SELECT pool.*, target FROM pool JOIN tq ON pool.query_id = tq.query_id)""")  # fmt: skip
FILL = """
fl AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, r, item_id) AS INTEGER) AS "rank", p = 1 AS filled FROM (
        SELECT query_id, item_id, min(p) AS p, arg_min(r, p * 1000000 + r) AS r FROM (SELECT query_id, item_id, 0 AS p, "rank" AS r FROM i2i
        UNION ALL SELECT query_id, item_id, 1, "rank" FROM tq CROSS JOIN hot WHERE NOT list_contains(history, item_id)) GROUP BY ALL))
"""


def _rank_metrics(cuts: tuple[int, ...], groups: str) -> str:
    return ", ".join(f"round(coalesce(sum(CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0 END), 0) / {groups}, 6) AS ndcg_{k}, round(coalesce(sum(CASE WHEN r <= {k} THEN 1 ELSE 0 END), 0) / CAST({groups} AS DOUBLE), 6) AS recall_{k}" for k in cuts)


def _ablation() -> str:
    ch = ["rank_hot", "rank_i2i", "rank_transition"]
    variants = {f"only_{c}": [c] for c in ch} | {f"without_{c}": [x for x in ch if x != c] for c in ch} | {"all": ch}
    parts = []
    for v, use in variants.items():
        s = " + ".join(f"coalesce(1 / (60.0 + {c}), 0)" for c in use)
        parts.append(f"SELECT '{v}' AS variant, item_id, target, CASE WHEN coalesce({', '.join(use)}) IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY round({s}, 9) DESC, item_id) END AS r FROM po")
    return _with(*POOL, f"v AS ({' UNION ALL '.join(parts)})") + f"SELECT variant, {_rank_metrics((20,), N_QUERIES)} FROM v WHERE item_id = target GROUP BY variant"


TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 1)"
TFIDF = f"""
pt AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOK.format('text')}) AS term FROM pt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
xw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM pt)) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.term = df.term),
wt AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM xw)
"""


def _tfidf(self_too: bool) -> str:
    cond = "" if self_too else "WHERE a.id <> b.id"
    keep = "WHERE \"rank\" <= 10" + (" AND query_id <> item_id" if self_too else "")
    cols = "query_id, item_id, score" + ("" if self_too else ', "rank"')
    return _with(TFIDF) + f"""SELECT {cols} FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM (
        SELECT a.id AS query_id, b.id AS item_id, round(sum(a.w * b.w), 6) AS score FROM wt a JOIN wt b ON a.term = b.term {cond} GROUP BY ALL)) {keep}"""


def _bm25() -> str:
    parts, ctes = [], []
    for f, w in {"p_name": 2.0, "p_type": 1.5, "p_brand": 0.5}.items():
        ctes.append(f"t_{f} AS (SELECT p_partkey AS id, {TOK.format(f)} AS t FROM part)")
        ctes.append(f"f_{f} AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM t_{f}) GROUP BY ALL)")
        ctes.append(f"d_{f} AS (SELECT term, count(*) AS df FROM f_{f} GROUP BY term)")
        total, mean = f"(SELECT count(*) FROM t_{f})", f"(SELECT avg(len(t)) FROM t_{f})"
        parts.append(f"SELECT id AS item_id, x.term, {w} * ln(1 + ({total} - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / {mean})) AS s FROM f_{f} x JOIN d_{f} y ON x.term = y.term")
    ctes.append(f"q AS (SELECT p_partkey AS query_id, unnest(list_distinct({TOK.format(chr(112) + '_name || chr(32) || p_type')})) AS term FROM part WHERE p_partkey % 50 = 0)")
    return _with(*ctes) + f"""SELECT query_id, item_id, score, "rank" FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM (
        SELECT query_id, item_id, round(sum(s), 6) AS score FROM q JOIN ({' UNION ALL '.join(parts)}) p ON q.term = p.term GROUP BY ALL)) WHERE "rank" <= 10"""


COMMERCE = """
ce AS (SELECT o_custkey AS client_id, CASE WHEN l_returnflag = 'R' THEN 'click' WHEN l_returnflag = 'A' THEN 'collect' ELSE 'buy' END AS action,
              epoch_us(o_orderdate) // 1000000 AS seconds, p_retailprice AS price, p_size AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def _profile() -> str:
    acts, at = ("buy", "collect", "click"), R.TEST_START // 1000
    cols = {f"{a}_count": f"count(*) FILTER (action = '{a}')" for a in acts}
    ratio = lambda n, d: f"CASE WHEN {d} > 0 THEN {n} / CAST({d} AS DOUBLE) ELSE 0 END"
    cols |= {"buy_per_collect": ratio(cols["buy_count"], cols["collect_count"]), "collect_per_click": ratio(cols["collect_count"], cols["click_count"])}
    for d in (1, 7, 30):
        hit = {a: f"action = '{a}' AND seconds >= {at - d * 86400}" for a in acts}
        cols |= {f"{a}_count_{d}d": f"count(*) FILTER ({hit[a]})" for a in acts}
        cols |= {f"buy_per_collect_{d}d": ratio(cols[f"buy_count_{d}d"], cols[f"collect_count_{d}d"])} | {f"{a}_price_mean_{d}d": f"avg(price) FILTER ({hit[a]})" for a in acts}
    cols |= {f"{a}_price_mean": f"avg(price) FILTER (action = '{a}')" for a in acts} | {f"{a}_price_std": f"stddev_pop(price) FILTER (action = '{a}')" for a in acts}
    cols["buy_over_collect_price"] = ratio(cols["buy_price_mean"], cols["collect_price_mean"])
    return _with(COMMERCE) + "SELECT c_custkey AS client_id, " + ", ".join(f"round({log0(v)}, 4) AS {k}" for k, v in cols.items()) + " FROM customer LEFT JOIN ce ON c_custkey = client_id GROUP BY c_custkey"


PAIRS = [("rank_hot", "rank_i2i"), ("rank_hot", "rank_transition"), ("rank_i2i", "rank_transition")]
FOLDS = "hs AS (SELECT DISTINCT user_id, CAST('0x' || substr(md5('0:' || user_id), 1, 8) AS BIGINT) AS h FROM exposures), fo AS (SELECT user_id, CAST(h % 5 AS INTEGER) AS fold, CASE WHEN (h // 5) % 2 = 0 THEN 'cg_val' ELSE 'reranker_val' END AS part FROM hs)"
STATS = 'SELECT split, {}CAST(count(*) AS BIGINT) AS n_rows, min("timestamp") AS first_ms, max("timestamp") AS last_ms FROM {} GROUP BY ALL'


def _greedy() -> str:
    """Metrics of every set of channels over the one fused ranking, then the greedy walk through the sets."""
    ch = ["rank_hot", "rank_i2i", "rank_transition"]
    score = " + ".join(f"coalesce(1 / (60.0 + {c}), 0)" for c in ch)
    parts = []
    for m in range(1, 8):
        some = f"coalesce({', '.join(c for i, c in enumerate(ch) if m >> i & 1)}) IS NOT NULL"
        parts.append(f"SELECT {m} AS m, round(coalesce(sum(1 / log2(r + 1)) FILTER (r <= 20), 0) / {N_QUERIES}, 6) AS n, round(count(*) FILTER (r <= 20) / {N_QUERIES}, 6) AS c FROM (SELECT item_id, target, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM fs WHERE {some}) WHERE item_id = target")
    bits = "bits AS (VALUES " + ", ".join(f"(1 << {i}, '{c}')" for i, c in enumerate(ch)) + ")"
    steps = ["g1 AS (SELECT 1 AS step, b.name, ms.* FROM ms JOIN bt b ON ms.m = b.bit ORDER BY n DESC, c DESC, b.name DESC LIMIT 1)"]
    steps += [f"g{k} AS (SELECT {k} AS step, b.name, ms.* FROM g{k - 1} p JOIN bt b ON (p.m & b.bit) = 0 JOIN ms ON ms.m = (p.m | b.bit) ORDER BY ms.n DESC, ms.c DESC, b.name DESC LIMIT 1)" for k in (2, 3)]
    return _with(*POOL, f"fs AS (SELECT *, round({score}, 9) AS s FROM po)", f"ms AS MATERIALIZED ({' UNION ALL '.join(parts)})", bits.replace("bits AS (", "bt(bit, name) AS ("), *steps) + " UNION ALL ".join(f"SELECT step, name AS channel, n AS ndcg_20, c AS recall_20 FROM g{k}" for k in (1, 2, 3))


def _features() -> str:
    w, out = "OVER (PARTITION BY query_id)", []
    for c in ("hot", "i2i", "transition"):
        s = f"score_{c}"
        out.append(f"coalesce(CASE WHEN max({s}) {w} > min({s}) {w} THEN ({s} - min({s}) {w}) / (max({s}) {w} - min({s}) {w}) END, 0) AS minmax_{c}, coalesce(CASE WHEN stddev_pop({s}) {w} > 0 THEN ({s} - avg({s}) {w}) / stddev_pop({s}) {w} END, 0) AS z_{c}, CAST(coalesce(rank_{c} <= 10, false) AS INTEGER) AS in_top10_{c}")
    join = " ".join(f"LEFT JOIN (SELECT query_id, item_id, score AS score_{c} FROM {t}) {t}_ USING (query_id, item_id)" for c, t in (("hot", "hq"), ("i2i", "i2i"), ("transition", "trn")))
    agree, total = " + ".join(f"in_top10_{c}" for c in ("hot", "i2i", "transition")), " + ".join(f"minmax_{c}" for c in ("hot", "i2i", "transition"))
    rounded = ", ".join(f"round({n}_{c}, 4) AS {n}_{c}" for c in ("hot", "i2i", "transition") for n in ("score", "minmax", "z"))
    return _with(*POOL, f"j AS (SELECT * FROM pool {join})", f"f AS (SELECT *, {', '.join(out)} FROM j)") + f"SELECT * REPLACE ({rounded}), {agree} AS agreement_top10, round({total}, 4) AS minmax_sum, round(({total}) * ({agree}), 4) AS minmax_mnz FROM f"


def _audit() -> str:
    return _with(S, SP) + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n_values, count(*) FILTER (n > 1) AS shared, CAST(sum(u) AS BIGINT) AS unassigned_rows FROM (SELECT count(DISTINCT split) AS n, count(*) FILTER (split IS NULL) AS u FROM split GROUP BY {k})" for k in ("sample_id", "group_id", "user_id", "item_id"))


def oracle_sql() -> dict[str, str]:
    return {
        "sample_projection": _with(S) + "SELECT * REPLACE (array_to_string(tags, ',') AS tags) FROM samples",
        "impression_explode": """WITH l AS (SELECT l_orderkey, l_partkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS candidate_count, CAST(l_partkey AS VARCHAR) AS item_id, label FROM l""",
        "sample_validation": _with(S) + """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS null_rows, CAST(sum(CAST(trim(sample_id) = '' AS INTEGER)) AS BIGINT) AS blank_ids, CAST(sum(CAST(label NOT IN (0, 1) AS INTEGER)) AS BIGINT) AS bad_labels,
count(sample_id) - count(DISTINCT sample_id) AS repeated_ids, (SELECT count(*) FROM (SELECT group_id FROM samples GROUP BY group_id HAVING count(DISTINCT (\"timestamp\", user_id, policy)) > 1)) AS mixed_groups FROM samples""",
        "temporal_split": _with(S, SP) + STATS.format("policy, ", "split"),
        "quantile_split": _with(X, Q, QSPLIT.format("seq")) + STATS.format("", "qs"),
        "popularity_scores": _with(S, SP, POP) + "SELECT sample_id, round(score, 6) AS score FROM pop WHERE split = 'test'",
        "impression_metrics": _with(S, SP, POP, GROUPS) + """SELECT split, count(*) AS n_groups, round(avg((sa - g.p * (g.p + 1) / 2.0) / (g.p * (n - g.p))), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(d5 / a.v), 6) AS ndcg5, round(avg(d10 / b.v), 6) AS ndcg10
FROM gm g JOIN ideal a ON a.p = g.p AND a.k = 5 JOIN ideal b ON b.p = g.p AND b.k = 10 GROUP BY split""",
        "binary_metrics": _with(X, QSPLIT.format("exposures"), XPOP) + _binary("pop", "split"),
        "policy_metrics": _with(X, QSPLIT.format("exposures"), XPOP, "te AS (SELECT * FROM pop WHERE split = 'test')") + f"""SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS policy, CAST(NULL AS VARCHAR) AS scene, * FROM ({_binary('te', '')})
UNION ALL SELECT 'policy', policy, NULL, n_rows, positives, auc, log_loss FROM ({_binary('te', 'policy')}) UNION ALL SELECT 'scene', policy, scene, n_rows, positives, auc, log_loss FROM ({_binary('te', 'policy, scene')})""",
        "pit_user_item_counts": _with(X) + "SELECT sample_id, " + ", ".join(
            f'CAST(coalesce(sum({v}) OVER (PARTITION BY item_id ORDER BY "timestamp" RANGE BETWEEN {"UNBOUNDED" if ms is None else ms - 1} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {n}_{w}' for w, ms in {**R.EVENT_WIDTHS, "all": None}.items() for n, v in (("seen", "1"), ("clicks", "label"))) + " FROM exposures",
        "interaction_features": _interaction(FROZEN),
        "interaction_features_replay": _interaction(None),
        "long_term_profile": LONG_TERM,
        "relative_freshness": _with(S, f"a AS (SELECT sample_id, group_id, CASE WHEN pub_time <= 0 THEN 87600.0 ELSE {AGE} END AS age FROM samples)") + """SELECT sample_id, round(ln(1 + age), 6) AS candidate_age_hours_log,
round((rank() OVER (PARTITION BY group_id ORDER BY age) + (count(*) OVER (PARTITION BY group_id, age) - 1) / 2.0 - 1) / greatest(count(*) OVER g - 1, 1), 6) AS freshness_rank_ratio, round(ln(1 + age - min(age) OVER g), 6) AS hours_from_freshest_log, CAST(age <= 24 AS INTEGER) AS published_within_24h
FROM a WINDOW g AS (PARTITION BY group_id)""",
        "candidate_ranks": _with(S) + "SELECT sample_id, " + ", ".join(
            f"round((rank() OVER (PARTITION BY group_id ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY group_id, {s}) - 1) / 2.0) / count(*) OVER g, 6) AS {s}_rank_pct, round({s} - avg({s}) OVER g, 6) AS {s}_minus_request_mean" for s in ("read_time", "position")) + " FROM samples WINDOW g AS (PARTITION BY group_id)",
        "session_exposure": _session(),
        "past_exposure": _exposure(),
        "past_exposure_momentum": _momentum(),
        "past_engagement": _engagement(),
        "fixed_history": HISTORY,
        "topic_affinity": TOPIC,
        "context_features": CONTEXT,
        "event_aggregates": EVENT_AGG,
        "visible_history": _with(S, f"p AS (SELECT sample_id, user_id, {_cut(R.INTERVAL, R.DELAY)} AS cut FROM samples)", """j AS (SELECT p.sample_id, c.item_id, c."timestamp" AS t, c.sample_id AS cs, row_number() OVER (PARTITION BY p.sample_id ORDER BY c."timestamp" DESC, c.sample_id DESC) AS n
FROM p LEFT JOIN (SELECT * FROM samples WHERE label = 1 AND policy <> 'random') c ON p.user_id = c.user_id AND c."timestamp" < p.cut)""") + "SELECT sample_id, coalesce(string_agg(item_id, ',' ORDER BY t, cs), '') AS history FROM j WHERE n <= 5 GROUP BY sample_id",
        "retrieval_queries": _with(X, Q, RQ) + "SELECT * REPLACE (array_to_string(history, ',') AS history) FROM qq",
        "even_sampling": _with(X, Q, 'o AS (SELECT event_id, "timestamp", row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS place, count(*) OVER () AS n FROM seq)') + 'SELECT event_id, "timestamp" FROM o WHERE n <= 500 OR place IN (SELECT (i * ((SELECT count(*) FROM seq) - 1)) // 499 FROM range(500) t(i))',
        "hot_items": _with(X, Q, TRAIN, HOT) + "SELECT * FROM hot",
        "item_cf": _with(X, Q, TRAIN, _icf(10)) + "SELECT * FROM nb",
        "user_cf": _with(X, Q, TRAIN, "sn AS (SELECT DISTINCT user_id, item_id FROM train)", "sz AS (SELECT user_id, count(*) AS n FROM sn GROUP BY user_id)",
            "sm AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM (SELECT x.user_id AS a, y.user_id AS b, round(count(*) / sqrt(any_value(p.n) * any_value(q.n)), 6) AS s FROM sn x JOIN sn y ON x.item_id = y.item_id AND x.user_id <> y.user_id JOIN sz p ON p.user_id = x.user_id JOIN sz q ON q.user_id = y.user_id GROUP BY ALL))",
            "sc AS (SELECT a AS query_id, item_id, round(sum(s), 6) AS score FROM sm JOIN sn ON sm.b = sn.user_id WHERE r <= 10 AND NOT EXISTS (SELECT 1 FROM sn z WHERE z.user_id = a AND z.item_id = sn.item_id) GROUP BY ALL)") + f'SELECT * FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM sc) WHERE "rank" <= 10',
        "i2i_recall": _with(*BASE, _icf(20), _i2i(20)) + "SELECT * FROM i2i",
        "i2i_hot_recall": _with(*BASE, HOT, _icf(20), _i2i(10), FILL) + 'SELECT * FROM fl WHERE "rank" <= 20',
        "retrieval_metrics": _with(*BASE, HOT, _icf(20), _i2i(10), FILL, 'm AS (SELECT tq.query_id, min("rank") AS r FROM tq LEFT JOIN fl ON tq.query_id = fl.query_id AND target = item_id AND "rank" <= 20 GROUP BY ALL)') + 'SELECT count(*) AS n_queries, round(avg(CAST(r IS NOT NULL AS INTEGER)), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, (SELECT count(DISTINCT item_id) FROM fl WHERE "rank" <= 20) AS n_items FROM m',
        "transition_recall": _with(*BASE, BI.format("train"), TRANS) + "SELECT * FROM trn",
        "transition_loso": _with(*BASE, BI.format("seq"), "ob AS (SELECT session_id, src, dst, count(*) AS n FROM (SELECT session_id, item_id AS src, lead(item_id) OVER (PARTITION BY session_id ORDER BY \"timestamp\", step, event_id) AS dst FROM seq) WHERE dst IS NOT NULL GROUP BY ALL)",
            "t AS (SELECT query_id, session_id, history, len(history) AS nh, unnest(history) AS src, generate_subscripts(history, 1) AS pos FROM tq)",
            "sc AS (SELECT query_id, bi.dst AS item_id, round(max(ln(1 + bi.n - coalesce(ob.n, 0)) / (nh - pos + 1)), 6) AS score FROM t JOIN bi ON t.src = bi.src LEFT JOIN ob ON ob.session_id = t.session_id AND ob.src = bi.src AND ob.dst = bi.dst WHERE bi.n > coalesce(ob.n, 0) AND NOT list_contains(history, bi.dst) GROUP BY ALL)") + f'SELECT * FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM sc) WHERE "rank" <= 20',
        "tfidf_recall": _tfidf(False),
        "content_i2i": _tfidf(True),
        "bm25_recall": _bm25(),
        "dense_recall": f"""SELECT query_id, item_id, score, "rank" FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE "rank" <= 10""",
        "embedding_presence": "SELECT label, count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim, count(*) FILTER (list_dot_product(embedding, embedding) > 0) AS present FROM embeddings GROUP BY label",
        "new_items": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT p_partkey AS item_id, CAST(DATE '1992-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS DATE) AS release FROM part WHERE p_size % 10 <> 0),
j AS (SELECT day, item_id, day - release AS age, row_number() OVER (PARTITION BY day ORDER BY release DESC, item_id) AS "rank" FROM d JOIN c ON release <= day), k AS (SELECT * FROM j WHERE "rank" <= 10)
SELECT day, item_id, round(CASE WHEN max(age) OVER w > min(age) OVER w THEN (max(age) OVER w - age) / CAST(max(age) OVER w - min(age) OVER w AS DOUBLE) ELSE 1 END, 6) AS score, "rank" FROM k WINDOW w AS (PARTITION BY day)""",
        "rrf_fusion": _with(*CHANNELS, 'u AS (SELECT query_id, item_id, round(sum(1.0 / (60 + "rank")), 9) AS score FROM (SELECT query_id, item_id, "rank" FROM hq UNION ALL SELECT query_id, item_id, "rank" FROM i2i UNION ALL SELECT query_id, item_id, "rank" FROM trn) GROUP BY ALL)') + f'SELECT * FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM u) WHERE "rank" <= 20',
        "weighted_fusion": _with(*CHANNELS, "u AS (SELECT query_id, item_id, round(sum(w * s), 6) AS score FROM (" + " UNION ALL ".join(f"SELECT query_id, item_id, {w} AS w, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0) AS s FROM {t}" for t, w in (("hq", 0.2), ("i2i", 0.5), ("trn", 0.3))) + ") GROUP BY ALL)") + f'SELECT * FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM u) WHERE "rank" <= 20',
        "top1_graft": _with(*CHANNELS, 'u AS (SELECT query_id, item_id, min(r) AS r FROM (SELECT query_id, item_id, "rank" AS r FROM i2i UNION ALL SELECT query_id, item_id, 0 FROM trn WHERE "rank" = 1) GROUP BY ALL)') + 'SELECT query_id, item_id, "rank" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, item_id) AS INTEGER) AS "rank" FROM u) WHERE "rank" <= 20',
        "candidate_pool": _with(*POOL) + "SELECT * FROM po",
        "training_requests": _with(*POOL) + "SELECT *, CAST(item_id = target AS INTEGER) AS label FROM po WHERE query_id IN (SELECT query_id FROM po WHERE item_id = target)",
        "request_summary": _with(*POOL, "q AS (SELECT query_id, max(CAST(item_id = target AS INTEGER)) AS hit, count(*) AS n FROM po GROUP BY query_id)") + "SELECT count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(hit), 6) AS candidate_recall FROM q",
        "entity_affinity": _with(*POOL, "it AS (SELECT CAST(p_partkey - 1 AS VARCHAR) AS item_id, p_brand AS entity, list_distinct(string_split(p_type, ' ')) AS tags FROM part)", "hi AS (SELECT query_id, it.* FROM (SELECT query_id, unnest(history) AS h FROM tq) JOIN it ON h = item_id)",
            "en AS (SELECT query_id, entity, count(*) AS n FROM hi GROUP BY ALL)", "tg AS (SELECT query_id, tag, count(*) AS n FROM (SELECT query_id, unnest(tags) AS tag FROM hi) GROUP BY ALL)", "tt AS (SELECT query_id, sum(n) AS n FROM tg GROUP BY query_id)",
            "cand AS (SELECT pool.query_id, it.*, len(history) AS nh FROM pool JOIN it ON pool.item_id = it.item_id JOIN tq ON tq.query_id = pool.query_id)",
            "ht AS (SELECT c.query_id, item_id, sum(tg.n) AS n FROM (SELECT query_id, item_id, unnest(tags) AS tag FROM cand) c JOIN tg ON c.query_id = tg.query_id AND c.tag = tg.tag GROUP BY ALL)") + """SELECT c.query_id, c.item_id, round(coalesce(en.n, 0) / CAST(greatest(nh, 1) AS DOUBLE), 6) AS entity_share, round(coalesce(ht.n / CAST(tt.n AS DOUBLE), 0), 6) AS tag_share
FROM cand c LEFT JOIN en ON en.query_id = c.query_id AND en.entity = c.entity LEFT JOIN ht ON ht.query_id = c.query_id AND ht.item_id = c.item_id LEFT JOIN tt ON tt.query_id = c.query_id""",
        "channel_overlap": _with(*POOL) + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS both, count(*) FILTER ({a} IS NOT NULL OR {b} IS NOT NULL) AS either, round(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) / CAST(greatest(count(*) FILTER ({a} IS NOT NULL OR {b} IS NOT NULL), 1) AS DOUBLE), 6) AS jaccard FROM po" for a, b in PAIRS),
        "rank_metrics_ablation": _ablation(),
        "exclusive_hits": _with(*POOL, "h AS (SELECT *, CAST(rank_hot IS NOT NULL AS INTEGER) + CAST(rank_i2i IS NOT NULL AS INTEGER) + CAST(rank_transition IS NOT NULL AS INTEGER) AS n FROM po WHERE item_id = target)") + " UNION ALL ".join(f"SELECT '{c}' AS channel, round(count({c}) / {N_QUERIES}, 6) AS hit_share, round(count(*) FILTER ({c} IS NOT NULL AND n = 1) / {N_QUERIES}, 6) AS exclusive_share FROM h" for c in ("rank_hot", "rank_i2i", "rank_transition")),
        "rank_metrics": _with(*BASE, _icf(20), _i2i(20), 'v AS (SELECT "rank" AS r FROM i2i JOIN tq ON i2i.query_id = tq.query_id AND item_id = target)') + f"SELECT {_rank_metrics((1, 10, 20), N_QUERIES)} FROM v",
        "catalog_diversity": _with(*BASE, _icf(20), _i2i(20)) + "SELECT count(DISTINCT item_id) AS recommended, (SELECT count(DISTINCT item_id) FROM exposures) AS catalog, round(count(DISTINCT item_id) / CAST((SELECT count(DISTINCT item_id) FROM exposures) AS DOUBLE), 6) AS diversity FROM i2i",
        "lexical_diversity": "WITH w AS (SELECT regexp_split_to_array(lower(trim(text, ' ')), '\\s+') AS w FROM conversations WHERE role = 'assistant'), g AS (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2), k AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM g) SELECT count(*) AS grams, count(DISTINCT gram) AS distinct_grams, round(count(DISTINCT gram) / CAST(count(*) AS DOUBLE), 6) AS lexical_diversity FROM k",
        "leakage_free_views": "SELECT a.conv_id, a.turn AS target, count(*) AS n_turns, max(b.turn) AS last_turn, CAST(sum(length(b.text)) AS BIGINT) AS chars FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn BETWEEN 0 AND 8) a JOIN conversations b ON a.conv_id = b.conv_id AND (b.turn < a.turn OR (b.turn = a.turn AND b.role = 'user')) GROUP BY a.conv_id, a.turn",
        "query_text": "WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') SELECT a.conv_id, a.turn, string_agg(b.text, ' ' ORDER BY b.turn) AS query FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 2 AND a.n GROUP BY a.conv_id, a.turn",
        "profiles_v1": _with(COMMERCE) + f"SELECT c_custkey AS client_id, round(ln(1 + count(seconds)), 6) AS event_count, round(ln(1 + count(DISTINCT seconds // 86400)), 6) AS event_active_days, round(ln(1 + count(DISTINCT category)), 6) AS event_unique_category_count, round(ln(1 + coalesce({R.TEST_START // 1000} - max(seconds), 0)), 6) AS event_recency_seconds, round(ln(1 + count(*) FILTER (seconds >= {R.TEST_START // 1000 - 30 * 86400})), 6) AS event_count_30d FROM customer LEFT JOIN ce ON c_custkey = client_id AND seconds < {R.TEST_START // 1000} GROUP BY c_custkey",
        "profiles_v2": _profile(),
        "category_hist": _with(COMMERCE, "b AS (SELECT client_id, CAST(category % 32 AS INTEGER) AS bin, sum(CASE action WHEN 'buy' THEN 3.0 WHEN 'collect' THEN 2.0 ELSE 1.0 END) AS w FROM ce GROUP BY ALL)") + "SELECT client_id, bin, round(w / CAST(sum(w) OVER (PARTITION BY client_id) AS DOUBLE), 6) AS share FROM b",
        "label_flags": _with(COMMERCE, f"t AS (SELECT DISTINCT client_id, category FROM ce WHERE action = 'buy' AND seconds >= {R.TEST_START // 1000})") + "SELECT c_custkey AS client_id, CAST(count(category) = 0 AS INTEGER) AS churn, coalesce(string_agg(CAST(category AS VARCHAR), ',' ORDER BY category), '') AS categories FROM customer LEFT JOIN t ON c_custkey = client_id GROUP BY c_custkey",
        "aligned_vectors": "SELECT doc_id, embedding IS NULL AS missing, 64 AS dim, round(coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0), 4) AS total FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
        "user_folds": _with(X, FOLDS) + "SELECT user_id, fold, part FROM fo",
        "fold_sizes": _with(X, FOLDS) + "SELECT fold, part, count(*) AS n_rows, count(DISTINCT fo.user_id) AS n_users FROM fo JOIN exposures x ON fo.user_id = x.user_id GROUP BY fold, part",
        "first_wins": _with(X) + 'SELECT user_id, item_id, "timestamp", sample_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY "timestamp", sample_id) AS n FROM exposures) WHERE n = 1',
        "title_fallback": "SELECT p_partkey, CASE WHEN vec_id IS NOT NULL THEN '' ELSE p_name END AS title FROM part LEFT JOIN embeddings ON p_partkey = vec_id",
        "history_mean_recall": _with(*BASE, "h AS (SELECT query_id, unnest(history[-5:]) AS item FROM tq)",
            "v AS (SELECT query_id, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM h JOIN embeddings ON item = CAST(vec_id AS VARCHAR))",
            "a AS (SELECT query_id, i, avg(x) AS x FROM v GROUP BY ALL)", "m AS MATERIALIZED (SELECT query_id, list(x ORDER BY i) AS x FROM a GROUP BY query_id)") + f"""SELECT query_id, item_id, score, "rank" FROM (SELECT *, CAST({TOP} AS INTEGER) AS "rank" FROM (
  SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(x, CAST(embedding AS DOUBLE[])), 6) AS score FROM m CROSS JOIN embeddings)) WHERE "rank" <= 10""",
        "group_ndcg": _with(S, SP, POP, "r AS (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, sample_id) AS r FROM pop WHERE split = 'test')", "h AS (SELECT group_id, CAST(min(r) FILTER (label > 0) AS INTEGER) AS first_hit FROM r GROUP BY group_id)") + "SELECT *, round(CASE WHEN first_hit <= 20 THEN 1 / log2(first_hit + 1) ELSE 0 END, 6) AS ndcg FROM h",
        "one_class_groups": _with(S) + "SELECT group_id, CAST(sum(label) AS BIGINT) AS p, count(*) AS n FROM samples GROUP BY group_id HAVING sum(label) = 0 OR sum(label) = count(*)",
        "greedy_ablation": _greedy(),
        "source_split": _with(X, "qs AS (SELECT *, CASE WHEN policy = 'random' THEN 'test' WHEN \"timestamp\" < (SELECT quantile_cont(\"timestamp\", 0.8) FROM exposures WHERE policy <> 'random') THEN 'train' ELSE 'validation' END AS split FROM exposures)") + STATS.format("", "qs"),
        "split_audit": _audit(),
        "prediction_coverage": _with(*BASE, _icf(20), _i2i(20), "l AS (SELECT query_id, count(*) AS n, count(DISTINCT item_id) AS d FROM i2i GROUP BY query_id)", "j AS (SELECT t.query_id AS q, l.* FROM (SELECT DISTINCT query_id FROM tq) t FULL JOIN l ON t.query_id = l.query_id)") + "SELECT count(q) AS n_queries, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (q IS NULL) AS unknown, count(*) FILTER (d < n) AS repeated, count(*) FILTER (d <> 20) AS not_k FROM j",
        "vocabulary_size": "SELECT CAST(greatest(max(l_partkey), max(l_suppkey)) + 1 AS BIGINT) AS vocabulary FROM lineitem",
        "period_history": _with(S, f"x AS (SELECT *, CAST(\"timestamp\" >= {R.TEST_START} AS INTEGER) AS period, CASE WHEN \"timestamp\" >= {R.TEST_START} THEN {R.TEST_START} ELSE {FROZEN} END AS at FROM samples WHERE \"timestamp\" >= {FROZEN})") + """SELECT x.sample_id, x.period, CAST(count(c.sample_id) AS INTEGER) AS n_history, coalesce(bool_or(c.item_id = x.item_id), false) AS seen
FROM x LEFT JOIN (SELECT * FROM samples WHERE label = 1) c ON c.user_id = x.user_id AND c."timestamp" < x.at GROUP BY x.sample_id, x.period""",
        "popular_channel": _with(X, Q, TRAIN, HOT) + 'SELECT item_id, round(1.0 / "rank", 6) AS score, CAST("rank" AS INTEGER) AS "rank" FROM hot WHERE "rank" <= 100',
        "usable_vectors": "SELECT vec_id, count(*) AS n_rows, coalesce(len(min(embedding)) = 64 AND list_bool_and(list_transform(min(embedding), lambda x: isfinite(x))) AND sqrt(list_sum(list_transform(min(embedding), lambda x: CAST(x AS DOUBLE) * x))) >= 1e-12, false) AS usable FROM embeddings GROUP BY vec_id",
        "candidate_features": _features(),
        "streaming_exposure": "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    }
