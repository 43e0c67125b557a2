"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from equipoise.plans.catalog import SEED

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_LIST = LINE.split(", ")

LINEITEM = """(SELECT *, CAST(l_quantity >= 48 AS INTEGER) AS label,
    [l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS features FROM lineitem)"""
EVENTS = """(SELECT *, CAST(event_type = 'error' AS INTEGER) AS label,
    [value, CAST(user_id AS DOUBLE), CAST(hour(ts) AS DOUBLE), CAST(day(ts) AS DOUBLE)] AS features FROM events)"""
ORDERS = "(SELECT *, CAST(o_totalprice >= 450000 AS INTEGER) AS label FROM orders)"


def vectors(rare: str = "label = 5") -> str:
    return f"""(SELECT vec_id, CAST({rare} AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""


def u(tag: str, *keys: str, seed: int = SEED) -> str:
    """U[0, 1) of a row."""
    text = ", ".join(["'|'", f"'{tag}|{seed}'", *keys])
    return f"(CAST('0x' || substr(md5(concat_ws({text})), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE))"


def cdf(name: str, rate: str, source: str) -> str:
    """CTE ``name(c)``: cumulative Poisson probabilities for the scalar ``rate`` of ``source``."""
    return f"""{name} AS (SELECT list(c ORDER BY i) AS c FROM (
        SELECT i, sum(exp(i * ln(r) - r - lgamma(i + 1.0))) OVER (ORDER BY i) AS c
        FROM range(0, 120) AS t(i), (SELECT {rate} AS r FROM {source}) AS rate))"""


def poisson(draw: str, table: str) -> str:
    return f"CAST(len(list_filter((SELECT c FROM {table}), lambda x: x < {draw})) AS INTEGER)"


def sizes(source: str) -> str:
    """CTE ``p(n_min, n_maj, l_min, l_maj)``; equal sizes are ordered by label."""
    return f"""n AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY label),
    p AS (SELECT min(n) AS n_min, max(n) AS n_maj,
          (SELECT label FROM n ORDER BY n, label LIMIT 1) AS l_min,
          (SELECT label FROM n ORDER BY n DESC, label DESC LIMIT 1) AS l_maj FROM n)"""


def long(source: str, *keep: str, digits: int = 6) -> str:
    cols = ", ".join(keep)
    return f"""SELECT {cols}, CAST(j - 1 AS INTEGER) AS j, round(features[j], {digits}) + 0.0 AS v
    FROM (SELECT {cols}, features, unnest(range(1, len(features) + 1)) AS j FROM {source})"""


def bounds(source: str) -> str:
    """CTE ``b(lo, hi)``: lists of per-feature bounds."""
    return f"""b AS (SELECT list(lo ORDER BY j) AS lo, list(hi ORDER BY j) AS hi FROM (
        SELECT j, min(x) AS lo, max(x) AS hi FROM (
            SELECT unnest(features) AS x, unnest(range(1, len(features) + 1)) AS j FROM {source}) GROUP BY j))"""


SCALED = """list_transform(range(1, len(features) + 1), lambda j:
    CASE WHEN b.hi[j] = b.lo[j] THEN 0.5 ELSE (features[j] - b.lo[j]) / (b.hi[j] - b.lo[j]) END)"""

ORACLE: dict[str, str] = {}

# ---- class profiles, labels, features -------------------------------------------------------------------------------

ORACLE["class_profile_binary"] = f"SELECT label, count(*) AS n FROM {LINEITEM} GROUP BY label"
ORACLE["class_profile_multi"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"
ORACLE["class_weighting"] = f"""WITH n AS (SELECT label, count(*) AS n FROM {ORDERS} GROUP BY label)
    SELECT o_orderkey, o.label, round((SELECT sum(n) FROM n) / 2.0 / n.n, 9) AS weight
    FROM {ORDERS} AS o JOIN n ON o.label = n.label"""
ORACLE["label_indexing"] = """WITH r AS (
    SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS INTEGER) AS label_index
    FROM events GROUP BY event_type)
    SELECT event_id, label_index, event_type AS decoded FROM events JOIN r USING (event_type)"""
ORACLE["minmax_scale"] = f"""WITH {bounds(vectors())},
    s AS (SELECT vec_id, {SCALED} AS features FROM {vectors()}, b)
    {long("s", "vec_id")}"""
ORACLE["minmax_unscale"] = long(EVENTS, "event_id")
ORACLE["feature_statistics"] = f"""SELECT CAST(j - 1 AS INTEGER) AS j, round(min(x), 6) AS low, round(max(x), 6) AS high,
    round(stddev_samp(x), 6) AS sd
    FROM (SELECT unnest(features) AS x, unnest(range(1, len(features) + 1)) AS j FROM {vectors()}) GROUP BY j"""
ORACLE["signed_labels"] = f"SELECT o_orderkey, 2 * label - 1 AS y FROM {ORDERS}"
ORACLE["distance_to_corner"] = f"""WITH {bounds(vectors())}
    SELECT vec_id, round(list_distance(features, b.lo), 6) AS distance FROM {vectors()}, b"""

# ---- sampling and resampling ----------------------------------------------------------------------------------------

ORACLE["bernoulli_sample"] = f"SELECT event_id, label FROM {EVENTS} WHERE {u('bernoulli', 'event_id')} < 0.3"
ORACLE["poisson_sample"] = f"""WITH {cdf("q", "2.5", "(SELECT 1)")},
    d AS (SELECT o_orderkey, {poisson(u("poisson", "o_orderkey"), "q")} AS n FROM orders)
    SELECT o_orderkey, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM d"""
ORACLE["bootstrap_sample"] = f"""WITH {cdf("q", "1.0", "(SELECT 1)")},
    d AS (SELECT event_id, {poisson(u("bootstrap", "event_id"), "q")} AS n FROM events)
    SELECT event_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM d"""
ORACLE["exact_size_sample"] = f"""SELECT {LINE} FROM lineitem ORDER BY {u("exact", *LINE_LIST)}, {LINE} LIMIT 1234"""
ORACLE["rus_hash"] = f"""WITH {sizes(LINEITEM)}
    SELECT {LINE}, label FROM {LINEITEM}, p WHERE label <> l_maj OR {u("under", *LINE_LIST)} < n_min / n_maj"""
ORACLE["rus_exact"] = f"""WITH {sizes(LINEITEM)},
    r AS (SELECT {LINE}, label, label = l_maj AS big,
          row_number() OVER (PARTITION BY label ORDER BY {u("under", *LINE_LIST)}, {LINE}) AS i FROM {LINEITEM}, p)
    SELECT {LINE}, label FROM r, p WHERE NOT big OR i <= n_min"""
ORACLE["rus_perc"] = f"""WITH {sizes(EVENTS)}
    SELECT event_id, label FROM {EVENTS}, p WHERE label <> l_maj OR {u("under", "event_id")} < 0.3"""


def _ros(source: str, key: str, rate: str) -> str:
    keys = key.split(", ")
    return f"""WITH {sizes(source)}, {cdf("q", rate, "p")},
    d AS (SELECT {key}, label, CASE WHEN label = l_min THEN {poisson(u("over", *keys), "q")} ELSE 0 END AS n FROM {source}, p)
    SELECT {key}, label, CAST(unnest(range(0, n + 1)) AS INTEGER) AS copy FROM d"""


ORACLE["ros_hash"] = _ros(LINEITEM, LINE, "(n_maj - n_min) / n_min")
ORACLE["ros_perc"] = _ros(EVENTS, "event_id", "2.5")
ORACLE["ros_exact"] = f"""WITH {sizes(ORDERS)},
    r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {u("over", "o_orderkey")}, o_orderkey) AS i
          FROM {ORDERS}),
    d AS (SELECT o_orderkey, label, CASE WHEN label <> l_min THEN 0 ELSE
          CAST(floor((n_maj - n_min) / n_min) AS INTEGER)
          + CAST(i <= CAST(n_maj - n_min AS BIGINT) % CAST(n_min AS BIGINT) AS INTEGER) END AS n FROM r, p)
    SELECT o_orderkey, label, CAST(unnest(range(0, n + 1)) AS INTEGER) AS copy FROM d"""


def _draw(seed: int) -> str:
    """CTE ``g``: new class sizes of random balance."""
    return f"""g AS (SELECT *, n_min + n_maj - m AS new_min, m AS new_maj FROM (
        SELECT *, 2 + floor({u("balance", seed=seed)} * (n_min + n_maj - 3)) AS m FROM p)),
    w AS (SELECT *, CASE WHEN new_min > n_min THEN l_min ELSE l_maj END AS grow,
        CASE WHEN new_min > n_min THEN new_min / n_min ELSE new_maj / n_maj END AS f_grow,
        CASE WHEN new_min > n_min THEN new_maj / n_maj ELSE new_min / n_min END AS f_shrink FROM g)"""


def _random_balance(seed: int) -> str:
    draw = u("balance", "o_orderkey", seed=seed)
    return f"""WITH {sizes(ORDERS)}, {_draw(seed)}, {cdf("q", "f_grow", "w")},
    d AS (SELECT o_orderkey, label, CASE WHEN label = grow THEN {poisson(draw, "q")}
          ELSE CAST({draw} < f_shrink AS INTEGER) END AS n FROM {ORDERS}, w)
    SELECT o_orderkey, label, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM d"""


ORACLE["random_balance_minority"] = _random_balance(7)
ORACLE["random_balance_majority"] = _random_balance(3)
ORACLE["random_balance_exact"] = f"""WITH {sizes(EVENTS)}, {_draw(SEED)},
    t AS (SELECT *, CASE WHEN grow = l_min THEN n_min ELSE n_maj END AS old_grow,
          CASE WHEN grow = l_min THEN new_min ELSE new_maj END AS new_grow,
          CASE WHEN grow = l_min THEN new_maj ELSE new_min END AS new_shrink FROM w),
    r AS (SELECT event_id, label, label = grow AS grows,
          row_number() OVER (PARTITION BY label ORDER BY
              CASE WHEN label = grow THEN {u("grow", "event_id")} ELSE {u("shrink", "event_id")} END, event_id) AS i
          FROM {EVENTS}, t),
    d AS (SELECT event_id, label, CASE WHEN grows THEN CAST(floor(new_grow / old_grow) AS INTEGER)
          + CAST(i <= CAST(new_grow AS BIGINT) % CAST(old_grow AS BIGINT) AS INTEGER)
          ELSE CAST(i <= new_shrink AS INTEGER) END AS n FROM r, t)
    SELECT event_id, label, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM d"""

ORACLE["union_missing_columns"] = """SELECT c_custkey, NULL AS s_suppkey, c_nationkey AS nation FROM customer
    UNION ALL SELECT NULL, s_suppkey, s_nationkey FROM supplier"""
ORACLE["shuffled_rows"] = f"""SELECT event_id, label,
    row_number() OVER (ORDER BY {u("shuffle", "event_id")}, event_id) - 1 AS place FROM {EVENTS}"""

# ---- nearest neighbours ---------------------------------------------------------------------------------------------


def _ranked(left: str, right: str, where: str, k: int) -> str:
    """k nearest by (distance, neighbour id) over vec_id, features tables."""
    return f"""SELECT * FROM (
        SELECT a.vec_id, b.vec_id AS nb_vec_id, b.label AS nb_label, list_distance(a.features, b.features) AS distance,
            CAST(row_number() OVER (PARTITION BY a.vec_id
                ORDER BY list_distance(a.features, b.features), b.vec_id) AS INTEGER) AS rank
        FROM {left} AS a, {right} AS b WHERE {where}) WHERE rank <= {k}"""


ORACLE["knn_self"] = f"""SELECT vec_id, rank, nb_vec_id, round(distance, 6) AS distance
    FROM ({_ranked(vectors(), vectors(), "true", 5)})"""
ORACLE["knn_routed_unbounded"] = ORACLE["knn_self"]
ORACLE["knn_query"] = f"""SELECT vec_id, rank, nb_vec_id, round(distance, 6) AS distance
    FROM ({_ranked(vectors("label <= 1"), vectors("label <= 1"), "a.label = 1 AND b.label = 0", 3)})"""
ORACLE["knn_max_distance"] = f"""WITH r AS ({_ranked(vectors(), vectors(), "a.vec_id <> b.vec_id", 4)}),
    g AS (SELECT vec_id, CAST(count(*) AS INTEGER) AS n, arg_min(nb_vec_id, rank) AS first_id,
          arg_min(nb_label, rank) AS first_label, round(max(distance), 6) AS farthest
          FROM r WHERE distance <= 1.15 GROUP BY vec_id)
    SELECT e.vec_id, coalesce(n, 0) AS n, first_id, first_label, farthest FROM embeddings AS e LEFT JOIN g USING (vec_id)"""


def _line_neighbours(scale_on: str, k: int) -> str:
    """CTE ``r``: the rare line items' neighbours on features scaled by the bounds of ``scale_on``."""
    gap = " + ".join(f"(a.s[{j}] - b.s[{j}]) * (a.s[{j}] - b.s[{j}])" for j in range(1, 5))
    differs = " OR ".join(f"a.{c} <> b.{c}" for c in LINE_LIST)
    keys = ", ".join(f"b.{c}" for c in LINE_LIST)
    named = ", ".join(f"b.{c} AS nb_{c}" for c in LINE_LIST)
    mine = ", ".join(f"a.{c}" for c in LINE_LIST)
    return f"""{bounds(scale_on)},
    m AS (SELECT {LINE}, features, {SCALED} AS s FROM {LINEITEM}, b WHERE label = 1),
    x AS (SELECT {mine}, {named}, b.features AS nb_features, sqrt({gap}) AS distance,
          CAST(row_number() OVER (PARTITION BY {mine} ORDER BY sqrt({gap}), {keys}) AS INTEGER) AS rank
          FROM m AS a, m AS b WHERE {differs}),
    r AS (SELECT * FROM x WHERE rank <= {k})"""


ORACLE["knn_regions"] = """WITH m AS (SELECT c_custkey, c_acctbal AS x, c_nationkey AS y, c_custkey AS z FROM customer),
    s AS (SELECT c_custkey, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x,
          (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())::DOUBLE AS y,
          (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ())::DOUBLE AS z FROM m),
    d AS (SELECT a.c_custkey, b.c_custkey AS nb_c_custkey,
          sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
          FROM s AS a, s AS b WHERE a.c_custkey <> b.c_custkey)
    SELECT c_custkey, CAST(rank AS INTEGER) AS rank, nb_c_custkey, round(distance, 9) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, nb_c_custkey) AS rank FROM d) WHERE rank <= 5"""
ORACLE["knn_sample"] = f"""WITH m AS (SELECT o_orderkey, o_custkey AS x, month(o_orderdate) AS y,
          CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS z FROM orders),
    s AS (SELECT o_orderkey, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())::DOUBLE AS x,
          (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())::DOUBLE AS y,
          (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ())::DOUBLE AS z FROM m),
    d AS (SELECT a.o_orderkey, b.o_orderkey AS nb_o_orderkey,
          sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
          FROM s AS a, s AS b WHERE a.o_orderkey <> b.o_orderkey
          AND {u("recall", "a.o_orderkey")} < least(1.0, 400.0 / (SELECT count(*) FROM orders)))
    SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, nb_o_orderkey, round(distance, 9) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY distance, nb_o_orderkey) AS rank FROM d) WHERE rank <= 5"""
_FAR = "(SELECT vec_id, label, list_transform(features, lambda x: x + 1e8) AS features FROM %s)" % vectors()
ORACLE["knn_offset"] = f"""SELECT vec_id, rank, nb_vec_id, round(distance, 6) AS distance
    FROM ({_ranked(_FAR, _FAR, "a.vec_id <> b.vec_id", 5)})"""

_PIVOT_DRAW = u("pivot", "vec_id", seed=0)


def _routed(pivots: int, tau: float, k: int) -> str:
    """CTE ``r``: the k nearest vectors in the regions that a buffer of ``tau`` reaches."""
    return f"""v AS (SELECT * FROM {vectors()}),
    p AS (SELECT vec_id AS pid, features AS place FROM v
          WHERE {_PIVOT_DRAW} < least(1.0, {8 * pivots + 16}.0 / (SELECT count(*) FROM v)) ORDER BY {_PIVOT_DRAW} LIMIT {pivots}),
    d AS (SELECT vec_id, features, pid, list_distance(features, place) AS reach FROM v, p),
    near AS (SELECT vec_id, min(reach) AS nearest FROM d GROUP BY vec_id),
    home AS (SELECT vec_id, any_value(features) AS features, arg_min(pid, reach) AS pid FROM d GROUP BY vec_id),
    visit AS (SELECT d.vec_id, features, pid FROM d JOIN near USING (vec_id) WHERE reach - nearest <= {tau}),
    x AS (SELECT a.vec_id, b.vec_id AS nb_vec_id, list_distance(a.features, b.features) AS distance
          FROM visit AS a JOIN home AS b ON a.pid = b.pid),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, nb_vec_id) AS INTEGER) AS rank,
          count(*) OVER (PARTITION BY vec_id) AS found FROM x QUALIFY rank <= {k})"""


ORACLE["knn_routed_vectors"] = f"""WITH {_routed(8, 0.05, 5)}
    SELECT vec_id, rank, nb_vec_id, round(distance, 6) AS distance FROM r"""
ORACLE["knn_routed_short"] = f"""WITH {_routed(16, 0.0, 40)}
    SELECT vec_id, rank, nb_vec_id, round(distance, 6) AS distance FROM r WHERE found >= 40
    UNION ALL SELECT vec_id, rank, nb_vec_id, round(distance, 6) FROM ({_ranked(vectors(), vectors(), "true", 40)})
    WHERE vec_id NOT IN (SELECT vec_id FROM r WHERE found >= 40)"""

_TAU_DRAWS = " UNION ALL ".join(
    f"SELECT {i} AS sample, vec_id, features FROM {vectors()} "
    f"WHERE {u(f'tau{i}', 'vec_id')} < least(1.0, {s} / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings))"
    for i, s in enumerate(range(100, 1001, 100))
)
_TAU = f"""WITH d AS ({_TAU_DRAWS}),
    near AS (SELECT a.sample, a.vec_id, min(list_distance(a.features, b.features)) AS distance FROM d AS a JOIN d AS b
          ON a.sample = b.sample WHERE list_distance(a.features, b.features) > 0 GROUP BY a.sample, a.vec_id),
    t AS (SELECT sample, count(*) AS n, (SELECT avg(distance) FROM near WHERE near.sample = d.sample) AS mean_distance
          FROM d GROUP BY sample)"""
ORACLE["tau_samples"] = f"""{_TAU} SELECT sample, n, round(mean_distance, 6) AS mean_distance FROM t"""
ORACLE["tau_estimate"] = f"""{_TAU},
    q AS (SELECT DISTINCT n, round(mean_distance, 9) AS mean_distance FROM t WHERE mean_distance > 0),
    f AS (SELECT regr_slope(ln(mean_distance), ln(n)) AS slope, regr_intercept(ln(mean_distance), ln(n)) AS intercept,
          max(mean_distance) AS widest FROM q)
    SELECT round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(CASE WHEN slope < 0
        THEN exp(intercept + slope * ln((SELECT count(*) FROM embeddings))) / sqrt(-1.0 / slope)
        ELSE widest END, 4) AS tau FROM f"""

# ---- synthetic rows -------------------------------------------------------------------------------------------------


def _smote(target: str, rate: str, self: bool = False) -> str:
    where = "true" if self else "a.vec_id <> b.vec_id"
    pairs = _ranked("m", "m", where, 5).replace("a.features", "a.s").replace("b.features", "b.s")
    return f"""WITH {sizes(vectors())}, f AS (SELECT *, {rate} AS rate, {target} AS target FROM p), {bounds(vectors())},
    m AS (SELECT vec_id, label, features, {SCALED} AS s FROM {vectors()}, b, f WHERE label = target),
    r AS ({pairs}),
    c AS (SELECT m.vec_id, m.label, m.features, i, rate FROM m, f, (SELECT unnest(range(1, 100)) AS i)
          WHERE i <= ceil(rate)),
    k AS (SELECT *, CAST(floor({u("smote-pick", "vec_id", "i")} * (SELECT count(*) FROM r WHERE r.vec_id = c.vec_id))
          AS INTEGER) + 1 AS pick, {u("smote-gap", "vec_id", "i")} AS g FROM c
          WHERE {u("smote-keep", "vec_id", "i")} < rate / ceil(rate)),
    s AS (SELECT k.vec_id, k.label, CAST(i AS INTEGER) AS copy, list_transform(range(1, len(k.features) + 1),
          lambda j: k.features[j] + g * (nb.features[j] - k.features[j])) AS features
          FROM k JOIN r ON r.vec_id = k.vec_id AND r.rank = k.pick JOIN m AS nb ON nb.vec_id = r.nb_vec_id
          UNION ALL SELECT vec_id, label, 0, features FROM {vectors()})
    {long("s", "vec_id", "label", "copy")}"""


ORACLE["smote_balance"] = _smote("l_min", "(n_maj - n_min) / n_min")
ORACLE["smote_perc"] = _smote("l_min", "1.5")
ORACLE["smote_majority"] = _smote("l_maj", "0.4")
ORACLE["smote_self_neighbour"] = _smote("l_min", "2.0", self=True)
_ON_LINE = " AND ".join(f"r.{c} = k.{c}" for c in LINE_LIST)
ORACLE["smote_lineitem"] = f"""WITH {sizes(LINEITEM)}, f AS (SELECT (n_maj - n_min) / n_min AS rate FROM p),
    {_line_neighbours(LINEITEM, 5)},
    c AS (SELECT {LINE}, features, i, rate FROM m, f, (SELECT unnest(range(1, 100)) AS i) WHERE i <= ceil(rate)),
    k AS (SELECT *, CAST(floor({u("smote-pick", *LINE_LIST, "i")} * 5) AS INTEGER) + 1 AS pick,
          {u("smote-gap", *LINE_LIST, "i")} AS g FROM c WHERE {u("smote-keep", *LINE_LIST, "i")} < rate / ceil(rate)),
    s AS (SELECT {", ".join(f"k.{c}" for c in LINE_LIST)}, 1 AS label, CAST(i AS INTEGER) AS copy,
          list_transform([1, 2, 3, 4], lambda j: k.features[j] + g * (nb_features[j] - k.features[j])) AS features
          FROM k JOIN r ON {_ON_LINE} AND r.rank = k.pick
          UNION ALL SELECT {LINE}, label, 0, features FROM {LINEITEM})
    SELECT {LINE}, label, copy, {", ".join(f"round(features[{j + 1}], 5) AS f{j}" for j in range(4))} FROM s"""


def _noise(key: str, dim: int) -> str:
    """List of N(0, 1) draws: every digest gives two Box-Muller pairs of 32-bit uniforms."""
    digest = f"md5(concat_ws('|', 'rose-noise|{SEED}', {key}, i, j // 4))"

    def half(at: str) -> str:
        return f"(CAST('0x' || substr({digest}, {at}, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"

    first, second = "1 + 16 * ((j % 4) // 2)", "9 + 16 * ((j % 4) // 2)"
    return f"""list_transform(range(0, {dim}), lambda j: sqrt(-2.0 * ln(1.0 - {half(first)})) *
        CASE WHEN j % 2 = 0 THEN cos(2.0 * pi() * {half(second)}) ELSE sin(2.0 * pi() * {half(second)}) END)"""


def _rose(
    source: str, key: str, dim: int, mino: float = 0.5, shrink: float = 1.0, keep: bool = False, rus: bool = False, full: bool = False
) -> str:
    draw = u("rose", *key.split(", "))
    size = "2 * n_maj" if full else "n_min + n_maj"
    extra = 1 if keep else 0

    def copies(fraction: str, table: str) -> str:
        grown = f"range({1 - extra}, {poisson(draw, table)} + 1)"
        if not keep:
            return grown
        return f"CASE WHEN {fraction} > 1 THEN {grown} ELSE range(0, CAST({draw} < {fraction} AS INTEGER)) END"

    if rus:
        majority = "range(0, 1)" if full else f"range(0, CAST({draw} < least(1.0, f_maj) AS INTEGER))"
    else:
        majority = copies("f_maj", "q_maj")
    return f"""WITH {sizes(source)},
    f AS (SELECT *, ({size}) * {mino} / n_min AS f_min, ({size}) * (1.0 - {mino}) / n_maj AS f_maj FROM p),
    {cdf("q_min", f"greatest(f_min - {extra}, 1e-9)", "f")}, {cdf("q_maj", f"greatest(f_maj - {extra}, 1e-9)", "f")},
    sd AS (SELECT label, list(s * {shrink} * power(4.0 / (({dim} + 2) * n), 1.0 / ({dim} + 4)) ORDER BY j) AS h FROM (
        SELECT label, j, stddev_samp(x) AS s, CAST(count(*) AS DOUBLE) AS n FROM (
            SELECT label, unnest(features) AS x, unnest(range(1, len(features) + 1)) AS j FROM {source})
        GROUP BY label, j) GROUP BY label),
    d AS (SELECT {key}, label, features, unnest(CASE WHEN label = l_min THEN {copies("f_min", "q_min")}
          ELSE {majority} END) AS i FROM {source}, f),
    z AS (SELECT *, CASE WHEN i = 0 THEN NULL ELSE {_noise(key, dim)} END AS noise FROM d),
    s AS (SELECT {key}, z.label, CAST(i AS INTEGER) AS copy, CASE WHEN i = 0 THEN features ELSE
          list_transform(range(1, {dim} + 1), lambda j: features[j] + noise[j] * h[j]) END AS features
          FROM z JOIN sd ON sd.label = z.label)"""


_VEC_ROSE = (vectors("label <= 1"), "vec_id", 64)
_AS_LONG = long("s", "vec_id", "label", "copy")
ORACLE["rose_default"] = f"{_rose(*_VEC_ROSE)} {_AS_LONG}"
ORACLE["rose_keep_orig"] = f"{_rose(*_VEC_ROSE, keep=True, shrink=0.5)} {_AS_LONG}"
ORACLE["rose_majo_rus"] = f"{_rose(*_VEC_ROSE, rus=True, mino=0.4)} {_AS_LONG}"
ORACLE["rose_keep_majo_size"] = f"{_rose(*_VEC_ROSE, rus=True, full=True)} {_AS_LONG}"
ORACLE["rose_lineitem"] = f"""{_rose(LINEITEM, LINE, 4)}
    SELECT {LINE}, label, copy, {", ".join(f"round(features[{j + 1}], 5) AS f{j}" for j in range(4))} FROM s"""

# ---- losses, votes, draws of the ensembles --------------------------------------------------------------------------

_MARGINS = f"""(SELECT event_id, 2.0 * label - 1.0 AS y, (value - 50.0) / 100.0 AS margin, user_id + 1.0 AS w,
    [(value - 50.0) / 200.0, (user_id % 10 - 5.0) / 10.0, hour(ts) / 24.0 - 0.5] AS trees FROM {EVENTS})"""


def _loss(y: str, m: str) -> str:
    return f"2.0 * ln(1.0 + exp(-2.0 * {y} * {m}))"


ORACLE["gbt_residual_step"] = f"""SELECT event_id, round(4.0 * y / (1.0 + exp(2.0 * y * margin)), 6) AS residual,
    round({_loss("y", "margin")}, 6) AS loss FROM {_MARGINS}"""
ORACLE["weighted_error"] = f"""SELECT round(sum(w * {_loss("y", "margin")}) / sum(w), 9) AS error FROM {_MARGINS}"""
ORACLE["iteration_errors"] = " UNION ALL ".join(
    f"SELECT {i} AS iteration, round(sum(w * {_loss('y', f'({m})')}) / sum(w), 9) AS error FROM {_MARGINS}"
    for i, m in enumerate(("trees[1]", "trees[1] + 0.1 * trees[2]", "trees[1] + 0.1 * trees[2] + 0.1 * trees[3]"), 1)
)
ORACLE["residual_counts"] = f"""WITH c AS (SELECT residual, count(*) AS n FROM (
    SELECT round(4.0 * y / (1.0 + exp(2.0 * y * (l_discount - l_tax))), 9) AS residual
    FROM (SELECT *, 2.0 * label - 1.0 AS y FROM {LINEITEM})) GROUP BY residual)
    SELECT 'rarest' AS "of", residual, n FROM (SELECT * FROM c ORDER BY n, residual LIMIT 1)
    UNION ALL SELECT 'commonest', residual, n FROM (SELECT * FROM c ORDER BY n DESC, residual DESC LIMIT 1)"""
_ROUND = 81708543  # the seed of round 1
_BOOST_U = u("boost", "event_id", seed=_ROUND)

ORACLE["boost_draw_rus"] = f"""WITH {sizes(EVENTS)} SELECT event_id,
    CASE WHEN label = l_maj THEN CAST({_BOOST_U} < n_min / n_maj AS INTEGER) ELSE 1 END AS copies FROM {EVENTS}, p"""
ORACLE["boost_draw_ros"] = f"""WITH {sizes(EVENTS)}, {cdf("q", "(n_maj - n_min) / n_min", "p")} SELECT event_id,
    CASE WHEN label = l_maj THEN 1 ELSE 1 + {poisson(_BOOST_U, "q")} END AS copies FROM {EVENTS}, p"""
ORACLE["boost_draw_balance"] = f"""WITH {sizes(EVENTS)}, {_draw(_ROUND)}, {cdf("q", "f_grow", "w")} SELECT event_id,
    CASE WHEN label = grow THEN {poisson(_BOOST_U, "q")} ELSE CAST({_BOOST_U} < f_shrink AS INTEGER) END AS copies
    FROM {EVENTS}, w"""


def _bagging_draw(how: str) -> str:
    draw = u("resample0", "event_id", "i")
    if how == "rus":
        taken, rate = f"CASE WHEN label = l_maj THEN CAST({draw} < n_min / n_maj AS INTEGER) ELSE 1 END", "1.0"
    else:
        taken = f"CASE WHEN label = l_maj THEN 1 ELSE 1 + {poisson(draw, 'q')} END"
        rate = "(n_maj - n_min) / n_min"
    return f"""WITH {cdf("b", "1.0", "(SELECT 1)")},
    d AS (SELECT event_id, label, unnest(range(0, {poisson(u("bootstrap0", "event_id"), "b")})) AS i FROM {EVENTS}),
    {sizes("d")}, {cdf("q", rate, "p")},
    t AS (SELECT event_id, sum({taken}) AS copies FROM d, p GROUP BY event_id)
    SELECT event_id, CAST(coalesce(copies, 0) AS INTEGER) AS copies FROM events LEFT JOIN t USING (event_id)"""


ORACLE["bagging_draw_rus"] = _bagging_draw("rus")
ORACLE["bagging_draw_ros"] = _bagging_draw("ros")
ORACLE["identity_resample"] = f"SELECT event_id, label FROM {EVENTS}"
_MEMBER_BALANCE = (1797089810, 944847130)  # seeds of the members' random balance


def _member(how: str, member: int, source_rows: str = EVENTS, seed: int = SEED) -> str:
    """CTEs up to ``t(event_id, label, x0, x1, w)``: a member's bootstrap with how often each copy is taken."""
    draw = u(f"resample{member}", "event_id", "i", seed=seed)
    rest, rate, source = "", "1.0", "p"
    taken = "1"
    if how == "rus":
        taken = f"CASE WHEN label = l_maj THEN CAST({draw} < n_min / n_maj AS INTEGER) ELSE 1 END"
    if how == "ros":
        taken, rate = f"CASE WHEN label = l_maj THEN 1 ELSE 1 + {poisson(draw, 'q')} END", "(n_maj - n_min) / n_min"
    if how == "balance":
        rest, rate, source = f"{_draw(_MEMBER_BALANCE[member])},", "f_grow", "w"
        taken = f"CASE WHEN label = grow THEN {poisson(draw, 'q')} ELSE CAST({draw} < f_shrink AS INTEGER) END"
    return f"""{cdf("b", "1.0", "(SELECT 1)")},
    d AS (SELECT event_id, label, features[3] AS x0, features[4] AS x1,
          unnest(range(0, {poisson(u(f"bootstrap{member}", "event_id", seed=seed), "b")})) AS i FROM {source_rows}),
    {sizes("d")}, {rest} {cdf("q", rate, source)},
    t AS (SELECT event_id, label, x0, x1, {taken} AS w FROM d, {source})"""


def _stump(name: str, source: str, target: str) -> str:
    """CTE ``name(f, cut, low, high, mean)``: the split of x0 or x1 that leaves least variance (for 0/1, least impurity)."""
    side = "PARTITION BY f ORDER BY x"
    sums = ", ".join(f"sum({c}) OVER ({side}) AS l{c}, sum({c}) OVER (PARTITION BY f) AS t{c}" for c in ("w", "s", "q"))

    def spread(k: str) -> str:
        return f"({k}q - {k}s * {k}s / {k}w)"

    return f"""{name}_z AS (SELECT f, x, sum(w)::DOUBLE AS w, sum(w * {target})::DOUBLE AS s, sum(w * {target} * {target})::DOUBLE AS q
          FROM (SELECT *, unnest([0, 1]) AS f, unnest([x0, x1]) AS x FROM {source} WHERE w > 0) GROUP BY f, x),
    {name}_c AS (SELECT f, x, lead(x) OVER ({side}) AS nx, {sums} FROM {name}_z),
    {name}_r AS (SELECT *, tw - lw AS rw, ts - ls AS rs, tq - lq AS rq FROM {name}_c),
    {name} AS (SELECT f, (x + nx) / 2.0 AS cut, ls / lw AS low, rs / rw AS high, ts / tw AS mean FROM {name}_r
          WHERE nx IS NOT NULL ORDER BY {spread("l")} + {spread("r")}, f, x LIMIT 1)"""


def _stump_bagging(how: str) -> str:
    # Leaves that predict the same class are merged.
    one = """SELECT event_id, CASE WHEN (low > 0.5) = (high > 0.5) THEN mean
        WHEN CASE f WHEN 0 THEN features[3] ELSE features[4] END <= cut THEN low ELSE high END AS p"""
    members = " UNION ALL ".join(f"SELECT * FROM (WITH {_member(how, m)}, {_stump('cut_at', 't', 'label')} {one} FROM {EVENTS}, cut_at)" for m in (0, 1))
    return f"""SELECT event_id, round(avg(p), 9) AS probability, CAST(avg(p) > 0.5 AS INTEGER) AS prediction
    FROM ({members}) GROUP BY event_id"""


for _how in ("none", "rus", "ros", "balance"):
    ORACLE[f"stump_bagging_{'plain' if _how == 'none' else _how}"] = _stump_bagging(_how)
ORACLE["bagging_draw_balance"] = f"""WITH {_member("balance", 0)}, k AS (SELECT event_id, sum(w) AS copies FROM t GROUP BY event_id)
    SELECT event_id, CAST(coalesce(copies, 0) AS INTEGER) AS copies FROM events LEFT JOIN k USING (event_id)"""


def _stump_boosting(how: str, rate: float = 1.0) -> str:
    taken = {
        "none": "1",
        "rus": f"CASE WHEN label = l_maj THEN CAST({_BOOST_U} < n_min / n_maj AS INTEGER) ELSE 1 END",
        "ros": f"CASE WHEN label = l_maj THEN 1 ELSE 1 + {poisson(_BOOST_U, 'q')} END",
        "balance": f"CASE WHEN label = grow THEN {poisson(_BOOST_U, 'q')} ELSE CAST({_BOOST_U} < f_shrink AS INTEGER) END",
    }[how]
    table = "w" if how == "balance" else "p"
    grown = {"ros": "(n_maj - n_min) / n_min", "balance": "f_grow"}.get(how, "1.0")
    seen = [f"CAST({u(f'subsample{r}', 'event_id')} < {rate} AS INTEGER)" for r in (0, 1)]
    at = "CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END <= cut THEN low ELSE high END"
    return f"""WITH {sizes(EVENTS)}, {f"{_draw(_ROUND)}," if how == "balance" else ""} {cdf("q", grown, table)},
    e AS (SELECT event_id, label, 2.0 * label - 1.0 AS y, features[3] AS x0, features[4] AS x1, {seen[0]} AS w FROM {EVENTS}),
    {_stump("g0", "e", "y")},
    m AS (SELECT event_id, label, y, x0, x1, {at} AS margin FROM e, g0),
    r AS (SELECT *, 4.0 * y / (1.0 + exp(2.0 * y * margin)) AS res, {taken} * {seen[1]} AS w FROM m, {table}),
    {_stump("g1", "(SELECT x0, x1, res, w FROM r)", "res")},
    o AS (SELECT event_id, margin + 0.1 * {at} AS margin FROM m, g1)
    SELECT event_id, round(1.0 / (1.0 + exp(-2.0 * margin)), 9) AS probability, CAST(margin > 0 AS INTEGER) AS prediction FROM o"""


for _how in ("rus", "ros", "balance"):
    ORACLE[f"stump_boosting_{_how}"] = _stump_boosting(_how)
ORACLE["stump_boosting_subsample"] = _stump_boosting("none", 0.5)


def _plain_boosting(rounds: int, weight: str = "1.0", held: str = "false", tol: float = 0.0) -> str:
    """Boosting without draws, its rounds one after the other; with held-out rows, as many trees as the rule keeps."""
    at = "CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END <= cut THEN low ELSE high END"
    steps = [f"""WITH {sizes(EVENTS)}, s0 AS MATERIALIZED (SELECT event_id, 2.0 * label - 1.0 AS y, features[3] AS x0, features[4] AS x1,
        ({weight})::DOUBLE AS w, {held} AS held, 0.0::DOUBLE AS margin FROM {EVENTS}, p)"""]
    for r in range(rounds):
        res = "y" if r == 0 else "4.0 * y / (1.0 + exp(2.0 * y * margin))"
        steps.append(_stump(f"g{r}", f"(SELECT x0, x1, w, {res} AS res FROM s{r} WHERE NOT held)", "res"))
        steps.append(f"s{r + 1} AS MATERIALIZED (SELECT s{r}.* REPLACE (margin + {1.0 if r == 0 else 0.1} * {at} AS margin) FROM s{r}, g{r})")
    losses = " UNION ALL ".join(f"SELECT {r} AS r, sum(w * 2.0 * ln(1.0 + exp(-2.0 * y * margin))) / sum(w) AS loss FROM s{r} WHERE held" for r in range(1, rounds + 1))
    steps.append(f"v AS (SELECT r, loss, lag(loss) OVER (ORDER BY r) AS last FROM ({losses}))")
    steps.append(f"k AS (SELECT coalesce(min(r) - 1, {rounds}) AS k FROM v WHERE last - loss < {tol} * greatest(loss, 0.01))")
    ends = " UNION ALL ".join(f"SELECT event_id, margin FROM s{r}, k WHERE k = {r}" for r in range(1, rounds + 1))
    return f"""{", ".join(steps)}
    SELECT event_id, round(1.0 / (1.0 + exp(-2.0 * margin)), 9) AS probability, CAST(margin > 0 AS INTEGER) AS prediction FROM ({ends})"""


_BALANCED = "(n_maj + n_min) / 2.0 / CASE WHEN label = l_maj THEN n_maj ELSE n_min END"
ORACLE["stump_gbt_plain"] = _plain_boosting(3)
ORACLE["stump_gbt_weighted"] = _plain_boosting(3, _BALANCED)
ORACLE["stump_boosting_early_stop"] = _plain_boosting(6, held=f"{u('held-out', 'event_id')} < 0.3", tol=0.001)


def _stump_forest(weight: str) -> str:
    return f"""WITH {sizes(EVENTS)}, t AS (SELECT label, features[3] AS x0, features[4] AS x1, ({weight})::DOUBLE AS w FROM {EVENTS}, p),
    {_stump("cut_at", "t", "label")},
    o AS (SELECT event_id, CASE WHEN (low > 0.5) = (high > 0.5) THEN mean
        WHEN CASE f WHEN 0 THEN features[3] ELSE features[4] END <= cut THEN low ELSE high END AS p FROM {EVENTS}, cut_at)
    SELECT event_id, round(p, 9) AS probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM o"""


ORACLE["stump_forest_plain"] = _stump_forest("1.0")
ORACLE["stump_forest_weighted"] = _stump_forest(_BALANCED)
ORACLE["stump_bagging_loaded"] = ORACLE["stump_bagging_rus"]
_RESIDUAL_U = u("boost", "event_id", seed=1598980084)  # the seed of every round
ORACLE["stump_boosting_residual"] = f"""WITH e AS (SELECT event_id, 2.0 * label - 1.0 AS y, features[3] AS x0, features[4] AS x1, 1 AS w FROM {EVENTS}),
    {_stump("g0", "e", "y")},
    m AS (SELECT event_id, y, x0, x1, CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END <= cut THEN low ELSE high END AS margin FROM e, g0),
    r AS (SELECT *, 4.0 * y / (1.0 + exp(2.0 * y * margin)) AS res FROM m),
    c AS (SELECT res, count(*) AS n FROM r GROUP BY res),
    a AS (SELECT min(n) / max(n) AS rate, arg_max(res, n) AS maj FROM c),
    d AS (SELECT x0, x1, res, CASE WHEN res = maj THEN CAST({_RESIDUAL_U} < rate AS INTEGER) ELSE 1 END AS w FROM r, a),
    {_stump("g1", "d", "res")},
    o AS (SELECT event_id, margin + 0.1 * CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END <= cut THEN low ELSE high END AS margin FROM m, g1)
    SELECT event_id, round(1.0 / (1.0 + exp(-2.0 * margin)), 9) AS probability, CAST(margin > 0 AS INTEGER) AS prediction FROM o"""
ORACLE["soft_voting"] = """WITH m AS (SELECT event_id, value / 100.0 AS p FROM events
        UNION ALL SELECT event_id, (user_id % 10) / 10.0 FROM events
        UNION ALL SELECT event_id, hour(ts) / 24.0 FROM events),
    s AS (SELECT event_id, sum(1.0 - p) AS s0, sum(p) AS s1 FROM m GROUP BY event_id)
    SELECT event_id, CAST(s1 > s0 AS INTEGER) AS prediction, round(greatest(s0, s1) / (s0 + s1), 6) AS probability FROM s"""

# ---- evaluation -----------------------------------------------------------------------------------------------------


def _fold(folds: int, repetition: int) -> str:
    return f"CAST(1 + floor({u(f'fold{repetition}', *LINE_LIST)} * {folds}) AS INTEGER)"


ORACLE["kfold_assignment"] = f"SELECT {LINE}, {_fold(5, 1)} AS fold_1, {_fold(5, 2)} AS fold_2 FROM lineitem"
_DEALT = ", ".join(
    f"CAST(1 + (row_number() OVER (PARTITION BY label ORDER BY {u(f'fold{r}', *LINE_LIST)}, {LINE}) - 1) % 5 AS INTEGER) AS fold_{r}" for r in (1, 2)
)
ORACLE["kfold_stratified"] = f"""WITH d AS (SELECT {LINE}, max(label) AS label FROM {LINEITEM} GROUP BY ALL) SELECT {LINE}, label, {_DEALT} FROM d"""
_COUNTS = """sum(CAST(label = 1 AND guess = 1 AS BIGINT))::BIGINT AS tp, sum(CAST(label = 0 AND guess = 0 AS BIGINT))::BIGINT AS tn,
    sum(CAST(label = 0 AND guess = 1 AS BIGINT))::BIGINT AS fp, sum(CAST(label = 1 AND guess = 0 AS BIGINT))::BIGINT AS fn"""
_RULE = " UNION ALL ".join(
    f"SELECT {r} AS repetition, {_fold(2, r)} AS fold, label, CAST(l_extendedprice > 60000 AS INTEGER) AS guess FROM {LINEITEM}"
    for r in (1, 2)
)
ORACLE["confusion"] = f"SELECT repetition, fold, {_COUNTS} FROM ({_RULE}) GROUP BY repetition, fold"
ORACLE["prediction_sink"] = f"""SELECT 'lineitem' AS dataset, 'price_rule' AS algorithm, repetition, fold, {_COUNTS}
    FROM ({_RULE}) GROUP BY repetition, fold"""
ORACLE["summary"] = f"""SELECT 'lineitem' AS dataset, 'price_rule' AS algorithm, repetition, fold, {_COUNTS},
    CAST(0 AS BIGINT) AS train_time, CAST(0 AS BIGINT) AS predict_time FROM ({_RULE}) GROUP BY repetition, fold"""
ORACLE["libsvm_source"] = """SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(label AS DOUBLE)::VARCHAR) - 1 AS INTEGER)
    AS label, count(*) AS n, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS total FROM embeddings GROUP BY embeddings.label"""
_FOLD_SEEDS = {1: (1756459664, 1651806069), 2: (1913876576, 181427221)}  # seeds of the folds of each repetition


def _stump_cv(name: str, inside: bool, repetitions: int = 1, folds: int = 2, more: str = "") -> str:
    parts = []
    for r, f in [(r, f) for r in range(1, repetitions + 1) for f in range(1, folds + 1)]:
        seed, place = _FOLD_SEEDS[r][f - 1], f"CAST(1 + floor({u(f'fold{r}', 'event_id')} * {folds}) AS INTEGER)"
        train = f"(SELECT * FROM {EVENTS} WHERE {place} <> {f})" if folds > 1 else EVENTS
        if inside:
            taken = _member("rus", 0, train, seed)
        else:
            taken = f"""{sizes(train)}, t AS (SELECT event_id, label, features[3] AS x0, features[4] AS x1,
                CASE WHEN label = l_maj THEN CAST({u("under", "event_id", seed=seed)} < n_min / n_maj AS INTEGER) ELSE 1 END AS w
                FROM {train}, p)"""
        guess = "CASE WHEN CASE f WHEN 0 THEN features[3] ELSE features[4] END <= cut THEN low ELSE high END > 0.5"
        parts.append(f"""SELECT * FROM (WITH {taken}, {_stump("cut_at", "t", "label")}
            SELECT {r} AS repetition, {f} AS fold, label, CAST({guess} AS INTEGER) AS guess FROM {EVENTS}, cut_at WHERE {place} = {f})""")
    return f"""SELECT 'events' AS dataset, '{name}' AS algorithm, repetition, fold, {_COUNTS}{more}
        FROM ({" UNION ALL ".join(parts)}) GROUP BY repetition, fold"""


ORACLE["cv_stump_resampled"] = _stump_cv("rus_stump", False)
ORACLE["cv_stump_inside"] = _stump_cv("stump_rus", True)
ORACLE["cv_stump_resubstitution"] = _stump_cv("rus_stump", False, folds=1)
ORACLE["cv_stump_resumed"] = _stump_cv("rus_stump", False, repetitions=2, more=", repetition = 1 AS kept")
