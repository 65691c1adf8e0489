"""The same queries in plain SQL, for another engine to check the results against."""

from __future__ import annotations

from itertools import permutations, product

_PRODUCTS = """
li AS (
  SELECT l_partkey, MIN(l_suppkey) AS suppkey, MAX(l_orderkey) AS orderkey, COUNT(*) AS n_lines,
         MAX(l_quantity) AS max_qty, MAX(l_discount) AS max_disc, MIN(l_tax) AS min_tax
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT p.p_partkey AS ID, LOWER(p.p_type) AS Type,
    CAST(50 - p.p_size AS DOUBLE) / 50 AS Cotton,
    li.max_disc AS Organic_cotton, li.max_qty / 50 AS Polyester, li.min_tax AS Elastane,
    CASE sr.r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'America'
                   WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe'
         ELSE CASE WHEN p.p_partkey % 2 = 0 THEN 'NaN' END END AS Manufacturing_location,
    cr.r_name AS Use_location,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Machine wash_ hot' WHEN '2-HIGH' THEN 'Machine wash_ warm'
         WHEN '3-MEDIUM' THEN 'Machine wash_ cold' WHEN '4-NOT SPECIFIED' THEN 'Hand wash'
         ELSE 'Dry clean' END AS Washing_instruction,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Line dry' WHEN 'BUILDING' THEN 'Dry clean'
         WHEN 'FURNITURE' THEN 'Tumble dry_ low' WHEN 'HOUSEHOLD' THEN 'Tumble dry_ medium'
         END AS Drying_instruction,
    CAST(p.p_partkey % 2 AS INT) AS Material_label,
    CAST(li.n_lines AS INT) AS Transporation_distance,
    CAST(FLOOR((p.p_size - 1) / 10) AS INT) + 1 AS EI
  FROM part p
  JOIN li ON li.l_partkey = p.p_partkey
  JOIN supplier s ON s.s_suppkey = li.suppkey
  JOIN nation sn ON sn.n_nationkey = s.s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey
  JOIN orders o ON o.o_orderkey = li.orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey)"""

_DUMMIES = {
    "Manufacturing_location_Africa": "Manufacturing_location = 'Africa'",
    "Manufacturing_location_America": "Manufacturing_location = 'America'",
    "Manufacturing_location_Asia": "Manufacturing_location = 'Asia'",
    "Manufacturing_location_Europe": "Manufacturing_location = 'Europe'",
    "Manufacturing_location_Unknown": "Manufacturing_location IS NULL OR Manufacturing_location = 'NaN'",
    "Drying_instruction_Linedry": "Drying_instruction = 'Line dry'",
    "Drying_instruction_Dryclean": "Drying_instruction = 'Dry clean'",
    "Drying_instruction_Tumble": "Drying_instruction = 'Tumble dry_ low'",
    "Washing_instruction_Machinehot": "Washing_instruction IN ('Machine wash_ warm', 'Machine wash_ hot')",
    "Washing_instruction_Machinecold": "Washing_instruction = 'Machine wash_ cold'",
    "Washing_instruction_Handwash": "Washing_instruction = 'Hand wash'",
    "Washing_instruction_Dryclean": "Washing_instruction = 'Dry clean'",
}
_ENCODED = (
    _PRODUCTS
    + ",\nencoded AS (SELECT ID, Type, Cotton, Organic_cotton, Polyester, Elastane, Use_location, "
    + "Material_label, Transporation_distance, EI, "
    + ", ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END AS {name}" for name, rule in _DUMMIES.items())
    + " FROM products)"
)
_NUMBERS = ["Cotton", "Organic_cotton", "Polyester", "Elastane", "Material_label", "Transporation_distance"]
_ENCODED_NUMBERS = [*_NUMBERS, "EI", *_DUMMIES]
_STRINGS = ["Type", "Manufacturing_location", "Use_location", "Washing_instruction", "Drying_instruction"]

_SCORES = _PRODUCTS + """,
w AS (SELECT ID, Type, EI,
  CAST((ID * 7) % 11 + CASE WHEN EI = 1 THEN 8 ELSE 0 END AS DOUBLE) AS w1,
  CAST((ID * 5) % 11 + CASE WHEN EI = 2 THEN 8 ELSE 0 END AS DOUBLE) AS w2,
  CAST((ID * 3) % 11 + CASE WHEN EI = 4 THEN 8 ELSE 0 END AS DOUBLE) AS w4,
  CAST((ID * 2) % 11 + CASE WHEN EI = 5 THEN 8 ELSE 0 END AS DOUBLE) AS w5 FROM products),
scores AS (SELECT ID, Type, EI, w1 / 64 AS p1, w2 / 64 AS p2, CAST(0 AS DOUBLE) AS p3, w4 / 64 AS p4, w5 / 64 AS p5,
  CAST(CASE WHEN w1 >= w2 AND w1 >= w4 AND w1 >= w5 THEN 1 WHEN w2 >= w4 AND w2 >= w5 THEN 2
            WHEN w4 >= w5 THEN 4 ELSE 5 END AS DOUBLE) AS prediction FROM w)"""

_LINE_SCORES = """
line_scores AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS EI,
  l_extendedprice AS p1, l_extendedprice * l_discount AS p2, l_quantity AS p3 FROM lineitem)"""

_GAPPY = """
gappy AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price,
  CASE WHEN l_linestatus = 'O' THEN l_discount END AS discount,
  l_tax AS tax, CAST(7 AS DOUBLE) AS constant FROM lineitem)"""

_KEY_BUCKET = "CAST('0x' || substr(md5('42:' || CAST(ID AS VARCHAR)), 1, 8) AS BIGINT)"
# The part of the range that four fifths of the keys fall into.
_FOUR_FIFTHS = 3435973836


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _describe(table: str, numbers: list[str], strings: list[str], percents: tuple[int, ...] = ()) -> str:
    parts = []
    for c in numbers:
        stats = {
            "count": f"COUNT({c})", "mean": f"AVG({c})", "stddev": f"STDDEV_SAMP({c})",
            "min": f"MIN({c})", "max": f"MAX({c})",
        }
        stats |= {f"{p}%": f"quantile_cont({c}, {p / 100})" for p in percents}
        parts += [
            f"SELECT '{c}' AS column_name, '{s}' AS stat, ROUND(CAST({e} AS DOUBLE), 6) AS value, "
            f"CAST(NULL AS VARCHAR) AS text FROM {table}"
            for s, e in stats.items()
        ]
    for c in strings:
        parts.append(
            f"SELECT '{c}' AS column_name, 'count' AS stat, CAST(COUNT({c}) AS DOUBLE) AS value, "
            f"CAST(NULL AS VARCHAR) AS text FROM {table}"
        )
        parts += [
            f"SELECT '{c}' AS column_name, '{s.lower()}' AS stat, CAST(NULL AS DOUBLE) AS value, {s}({c}) AS text FROM {table}"
            for s in ("MIN", "MAX")
        ]
    return _union(parts)


def _profile(table: str, numbers: list[str], strings: list[str], sketched: bool = False) -> str:
    parts, places = [], 6 if sketched else 8
    for c in numbers:
        extra = "" if sketched else (
            f", COUNT(DISTINCT {c}) AS n_distinct, "
            + ", ".join(f"ROUND(quantile_cont(CAST({c} AS DOUBLE), {p / 100}), {places}) AS p{p}" for p in (25, 50, 75))
        )
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing, "
            f"ROUND(CAST(MIN({c}) AS DOUBLE), {places}) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), {places}) AS max, "
            f"CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, "
            f"ROUND(AVG({c}), {places}) AS mean, ROUND(STDDEV_SAMP({c}), {places}) AS stddev{extra} FROM {table}"
        )
    for c in strings:
        known = f"NULLIF({c}, 'NaN')"
        nothing = "CAST(NULL AS DOUBLE)"
        extra = "" if sketched else (
            f", COUNT(DISTINCT {known}) AS n_distinct, "
            + ", ".join(f"{nothing} AS p{p}" for p in (25, 50, 75))
        )
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({known}) AS n_missing, "
            f"{nothing} AS min, {nothing} AS max, MIN({known}) AS min_text, MAX({known}) AS max_text, "
            f"{nothing} AS mean, {nothing} AS stddev{extra} FROM {table}"
        )
    return _union(parts)


def _pearson(table: str, x: str, y: str) -> str:
    return (
        f"(SELECT CASE WHEN STDDEV_POP({x}) > 1e-12 AND STDDEV_POP({y}) > 1e-12 THEN ROUND(CORR({x}, {y}), 6) END "
        f"FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    )


def _corr_matrix(table: str, cols: list[str], diagonal: bool = False) -> str:
    pairs = product(cols, cols) if diagonal else permutations(cols, 2)
    return _union([f"SELECT '{x}' AS var_x, '{y}' AS var_y, {_pearson(table, x, y)} AS corr" for x, y in pairs])


def _chi_square(table: str, cols: list[str], label: str) -> str:
    cells = _union([f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {label} AS label FROM {table}" for c in cols])
    return f"""cells AS ({cells}),
o AS (SELECT feature, value, label, COUNT(*) AS o FROM cells GROUP BY ALL),
r AS (SELECT feature, value, COUNT(*) AS r FROM cells GROUP BY ALL),
c AS (SELECT feature, label, COUNT(*) AS c FROM cells GROUP BY ALL),
t AS (SELECT feature, COUNT(*) AS n FROM cells GROUP BY ALL),
grid AS (SELECT r.feature, t.n, CAST(r AS DOUBLE) * c / n AS e, COALESCE(o, 0) AS o
  FROM r JOIN c ON r.feature = c.feature JOIN t ON t.feature = r.feature
  LEFT JOIN o ON o.feature = r.feature AND o.value IS NOT DISTINCT FROM r.value AND o.label = c.label),
tested AS (SELECT feature, SUM((o - e) * (o - e) / e) AS statistic FROM grid GROUP BY feature)
SELECT s.feature, ROUND(s.statistic, 6) AS statistic, CAST(t.n AS BIGINT) AS n,
  CAST(((SELECT COUNT(*) FROM r WHERE r.feature = s.feature) - 1)
     * ((SELECT COUNT(*) FROM c WHERE c.feature = s.feature) - 1) AS BIGINT) AS degrees_of_freedom
FROM tested s JOIN t ON t.feature = s.feature"""


def _index(table: str, column: str) -> str:
    return (
        f"ix_{column} AS (SELECT {column} AS v, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {column}) - 1 AS DOUBLE) AS i "
        f"FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})"
    )


_VALUES = {
    "Type": ["economy", "large", "medium", "promo", "small", "standard"],
    "Manufacturing_location": ["Africa", "America", "Asia", "Europe", "NaN"],
    "Use_location": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "Washing_instruction": ["Machine wash_ hot", "Machine wash_ warm", "Machine wash_ cold", "Hand wash", "Dry clean"],
    "Drying_instruction": ["Line dry", "Dry clean", "Tumble dry_ low", "Tumble dry_ medium"],
}


def _hot(column: str) -> dict[str, str]:
    return {f"{column}_encoded_{v}": f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END" for v in _VALUES[column]}


_SLOTS = {k: v for c in _STRINGS for k, v in _hot(c).items()} | {"Material_label": "Material_label"}
_SELECTED = (
    _PRODUCTS
    + ",\nslots AS (" + _union([f"SELECT '{n}' AS feature, {i} AS slot, {e} AS value, EI AS label FROM products" for i, (n, e) in enumerate(_SLOTS.items())])
    + """),
so AS (SELECT feature, slot, value, label, COUNT(*) AS o FROM slots GROUP BY ALL),
sr AS (SELECT feature, value, COUNT(*) AS r FROM slots GROUP BY ALL),
sc AS (SELECT label, COUNT(*) AS c FROM products_labels GROUP BY label),
picked AS (SELECT so.feature, SUM(CAST(o AS DOUBLE) * o / (r * c)) AS s
  FROM so JOIN sr ON sr.feature = so.feature AND sr.value = so.value JOIN sc ON sc.label = so.label
  GROUP BY so.feature ORDER BY s DESC LIMIT 15)"""
).replace("products_labels", "(SELECT EI AS label FROM products) q")

_CONFUSION = """
per_class AS (SELECT CAST(k AS DOUBLE) AS label,
  (SELECT COUNT(*) FROM scores WHERE EI = k AND prediction = k) AS tp,
  (SELECT COUNT(*) FROM scores WHERE prediction = k) AS predicted,
  (SELECT COUNT(*) FROM scores WHERE EI = k) AS support
  FROM (SELECT DISTINCT EI AS k FROM scores) q),
rated AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall FROM per_class),
scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM rated)"""


# The columns of the line items, and the numeric ones.
_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_COLUMNS = [*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def _top_values(table: str, cols: list[str], share: float) -> str:
    return _union([
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n, "
        f"ROUND(COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM {table}), 6) AS share FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= {share} * (SELECT COUNT(*) FROM {table})"
        for c in cols
    ])


def _histograms(table: str, cols: list[str], bins: int) -> str:
    return _union([
        f"""SELECT '{c}' AS column_name, CAST(b AS INT) AS bucket, ROUND(lo + b * w, 6) AS lower, ROUND(lo + (b + 1) * w, 6) AS upper,
  (SELECT COUNT(*) FROM {table} WHERE LEAST(FLOOR((CAST({c} AS DOUBLE) - lo) / w), {bins - 1}) = b) AS n
FROM (SELECT CAST(MIN({c}) AS DOUBLE) AS lo, (CAST(MAX({c}) AS DOUBLE) - CAST(MIN({c}) AS DOUBLE)) / {bins} AS w FROM {table}), range({bins}) t(b)"""
        for c in cols
    ])


def _points(table: str, classes: list[int], score: str = "p{}") -> str:
    parts = _union([f"SELECT {k} AS label, {score.format(k)} AS score, EI = {k} AS hit FROM {table}" for k in classes])
    return f"""points AS ({parts}),
counts AS (SELECT label, score, COUNT(*) FILTER (WHERE hit) AS p, COUNT(*) FILTER (WHERE NOT hit) AS n
  FROM points GROUP BY label, score),
ranked AS (SELECT *, SUM(p) OVER d AS tp, SUM(n) OVER d AS fp, SUM(p) OVER g AS all_p, SUM(n) OVER g AS all_n
  FROM counts WINDOW g AS (PARTITION BY label),
    d AS (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_ROC = """
SELECT CAST(label AS INT) AS label, ROUND(score, 6) AS threshold, ROUND(CAST(fp AS DOUBLE) / all_n, 6) AS fpr,
  ROUND(CAST(tp AS DOUBLE) / all_p, 6) AS tpr FROM ranked
UNION ALL
SELECT DISTINCT CAST(label AS INT), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked"""

_CORNERS = """,
steps AS (SELECT *, LEAD(p) OVER d AS next_p, LEAD(n) OVER d AS next_n, ROW_NUMBER() OVER d AS place
  FROM ranked WINDOW d AS (PARTITION BY label ORDER BY score DESC))
SELECT CAST(label AS INT) AS label, ROUND(score, 6) AS threshold, ROUND(CAST(fp AS DOUBLE) / all_n, 6) AS fpr,
  ROUND(CAST(tp AS DOUBLE) / all_p, 6) AS tpr FROM steps
WHERE place = 1 OR next_p IS NULL OR next_p <> p OR next_n <> n
UNION ALL
SELECT DISTINCT CAST(label AS INT), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked"""

_AUC = """areas AS (SELECT CAST(label AS INT) AS label,
  SUM(CAST(p AS DOUBLE) * (all_n - fp + 0.5 * n)) / (CAST(MAX(all_p) AS DOUBLE) * MAX(all_n)) AS auc
  FROM ranked GROUP BY label)"""

_EIGEN = """
m AS (SELECT CORR(l_quantity, l_extendedprice) AS a, CORR(l_quantity, l_discount) AS b,
             CORR(l_extendedprice, l_discount) AS c FROM lineitem),
q AS (SELECT a * b * c AS abc, SQRT((a * a + b * b + c * c) / 3) AS p FROM m),
angle AS (SELECT p, ACOS(abc / (p * p * p)) / 3 AS phi FROM q),
ends AS (SELECT 1 + 2 * p * COS(phi) AS e1, 1 + 2 * p * COS(phi + 2 * PI() / 3) AS e3 FROM angle),
parts AS (SELECT 1 AS component, e1 / 3 AS ratio FROM ends
  UNION ALL SELECT 2, (3 - e1 - e3) / 3 FROM ends UNION ALL SELECT 3, e3 / 3 FROM ends),
running AS (SELECT component, ratio, SUM(ratio) OVER (ORDER BY component) AS cumulative FROM parts)"""

_SLOT_COLUMNS = "p1, p2, p3, p4, p5"
_SCORE_ORDER = "p1 DESC, p2 DESC, p3 DESC, p4 DESC, p5 DESC, ID"


def _roles() -> str:
    types = {"ID": "bigint", "Type": "string", "Use_location": "string"}
    types |= dict.fromkeys(["Cotton", "Organic_cotton", "Polyester", "Elastane"], "double")
    order = [
        "ID", "Type", "Cotton", "Organic_cotton", "Polyester", "Elastane", "Use_location",
        "Material_label", "Transporation_distance", "EI", *_DUMMIES,
    ]
    roles = {"ID": "key", "EI": "label", "Type": "categorical", "Use_location": "categorical"}
    return _union([
        f"SELECT {i} AS position, '{c}' AS column_name, '{types.get(c, 'int')}' AS data_type, "
        f"'{roles.get(c, 'numeric')}' AS role, {str(types.get(c) == 'double').upper()} AS in_double_only, "
        f"COUNT({c}) AS n_present, COUNT(*) AS n_rows FROM encoded"
        for i, c in enumerate(order)
    ])


def _separable() -> str:
    return _with(_PRODUCTS) + f"SELECT ID, CAST(EI AS DOUBLE) AS prediction FROM products WHERE {_KEY_BUCKET} >= {_FOUR_FIFTHS}"


def _large_moments() -> str:
    columns = {
        "seconds": "CAST(epoch(l_shipdate) AS BIGINT)", "large_key": "1700000000000000 + l_orderkey",
        "tight": "1e9 + l_linenumber * CAST(1e-3 AS DOUBLE)",
    }
    return _union([
        f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, printf('%.9e', AVG({e})) AS mean, "
        f"printf('%.2e', STDDEV_SAMP({e})) AS stddev FROM lineitem"
        for c, e in columns.items()
    ])


def _p_values(cols: list[str]) -> str:
    """Tail probabilities for an even number of degrees of freedom."""
    return "tested_columns AS (WITH " + _chi_square("lineitem", cols, "l_returnflag") + """),
p_values AS (SELECT feature, statistic, degrees_of_freedom, list_sum(list_transform(range(0, degrees_of_freedom // 2),
    lambda k: exp(k * ln(statistic / 2) - lgamma(k + 1) - statistic / 2))) AS p_value FROM tested_columns)"""


def oracle_queries() -> dict[str, str]:
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    indexed = ["Manufacturing_location", "Drying_instruction"]
    index_parts = [_index("products", c) for c in indexed]
    joins = " ".join(f"LEFT JOIN ix_{c} ON ix_{c}.v = products.{c}" for c in indexed)
    return {
        "preview": _with(_PRODUCTS) + "SELECT * FROM products ORDER BY ID LIMIT 20",
        "schema_columns": _with(_ENCODED) + _roles(),
        "project_columns": _with(_SCORES) + "SELECT ID, Type, p1, EI FROM scores",
        "drop_columns": _with(_PRODUCTS) + "SELECT * EXCLUDE (Use_location, Drying_instruction) FROM products",
        "filter_type": _with(_PRODUCTS) + "SELECT * FROM products WHERE Type = 'promo'",
        "filter_membership": _with(_SCORES) + "SELECT ID, Type, prediction, EI FROM scores WHERE prediction IN (1, 2)",
        "missing_location_count": _with(_PRODUCTS)
        + "SELECT COUNT(*) FILTER (WHERE Manufacturing_location = 'NaN') AS n_sentinel, "
        + "COUNT(*) FILTER (WHERE Manufacturing_location IS NULL OR Manufacturing_location = 'NaN') AS n_missing FROM products",
        "duplicate_rows": "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
        "duplicate_rows_by_hash": "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
        "duplicate_products": _with(_PRODUCTS)
        + "SELECT Type, Manufacturing_location, Drying_instruction, Washing_instruction, EI FROM products GROUP BY ALL HAVING COUNT(*) > 1",
        "describe_long": _describe("lineitem", ["l_orderkey", *numbers], ["l_returnflag", "l_linestatus"]),
        "summary_long": _describe("lineitem", numbers, ["l_returnflag"], (25, 50, 75)),
        "profile_columns": _with(_PRODUCTS) + _profile("products", ["ID", *_NUMBERS, "EI"], _STRINGS),
        "profile_one_scan": _profile("lineitem", numbers, ["l_returnflag"], sketched=True),
        "column_histogram": """
WITH b AS (SELECT MIN(l_extendedprice) AS lo, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 20 AS w FROM lineitem),
h AS (SELECT CAST(LEAST(FLOOR((l_extendedprice - lo) / w), 19) AS INT) AS bucket, COUNT(*) AS n FROM lineitem, b GROUP BY 1)
SELECT bucket, ROUND(lo + bucket * w, 6) AS lower, ROUND(lo + (bucket + 1) * w, 6) AS upper, COALESCE(n, 0) AS n
FROM b, (SELECT CAST(UNNEST(RANGE(20)) AS INT) AS bucket) LEFT JOIN h USING (bucket)""",
        "profile_large_values": _large_moments(),
        "profile_large_values_exact": _large_moments(),
        "csv_round_trip": "SELECT doc_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS hash FROM documents",
        "corr_matrix_small_spread": _with("""
lines AS (SELECT l_linenumber AS line, 1e9 + l_linenumber * CAST(1e-5 AS DOUBLE) AS tight,
  1700000000000000 + l_linenumber * 1000 AS large FROM lineitem)""")
        + _union([
            f"SELECT '{x}' AS var_x, '{y}' AS var_y, ROUND(CORR({x}, {y}), 2) AS corr FROM lines"
            for x, y in permutations(["line", "tight", "large"], 2)
        ]),
        "chi_square_p_values": _with(_p_values(["l_linenumber", "l_discount", "l_tax"]))
        + "SELECT feature, degrees_of_freedom, ROUND(p_value, 6) AS p_value FROM p_values",
        "select_continuous": _with(_p_values(["l_extendedprice", "l_quantity", "l_discount"]))
        + "SELECT feature FROM p_values ORDER BY p_value, statistic DESC LIMIT 1",
        "index_many_values": _with(_index("part", "p_name"))
        + "SELECT p_partkey, p_name, COALESCE(i, (SELECT CAST(COUNT(*) AS DOUBLE) FROM ix_p_name)) AS p_name_index "
        + "FROM part LEFT JOIN ix_p_name ON v = p_name",
        "one_hot_many_values": _with(
            _index("part", "p_name"), _index("part", "p_brand"),
            "sizes AS (SELECT (SELECT COUNT(*) FROM ix_p_name) AS names, (SELECT COUNT(*) FROM ix_p_brand) AS brands)",
        )
        + _union([
            f"SELECT p_partkey, CAST(names + brands + 1 AS INT) AS n_slots, CAST({slot} AS BIGINT) AS slot, '{c}' AS feature, "
            f"{value} AS value, CAST({weight} AS DOUBLE) AS weight FROM sizes, part {join}"
            for c, slot, value, weight, join in [
                ("p_name", "i", "p_name", "1", "JOIN ix_p_name ON v = p_name"),
                ("p_brand", "names + i", "p_brand", "1", "JOIN ix_p_brand ON v = p_brand"),
                ("p_size", "names + brands", "CAST(NULL AS VARCHAR)", "p_size", "WHERE p_size <> 0"),
            ]
        ]),
        "split_per_mille": "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) "
        + "AS BIGINT) < 4277787426 THEN 0 ELSE 1 END AS part FROM orders",
        "metrics_with_missing_labels": _with(
            _SCORES, "labelled AS (SELECT * FROM scores WHERE ID % 10 <> 0)", _CONFUSION.replace("FROM scores", "FROM labelled")
        )
        + "SELECT ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS accuracy, "
        + "ROUND(SUM(precision * support) / SUM(support), 6) AS weighted_precision, "
        + "ROUND(SUM(recall * support) / SUM(support), 6) AS weighted_recall, "
        + "ROUND(SUM(f1 * support) / SUM(support), 6) AS f1, "
        + "ROUND(1 - CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS test_error, "
        + "(SELECT COUNT(*) FROM scores) AS n_rows, (SELECT COUNT(*) FROM scores WHERE ID % 10 = 0) AS n_unlabelled FROM scored",
        "top_2000_per_type": _with(_SCORES)
        + f"SELECT * FROM (SELECT ID, Type, EI, {_SLOT_COLUMNS}, CAST(ROW_NUMBER() OVER (PARTITION BY Type ORDER BY {_SCORE_ORDER}) AS INT) AS rank "
        + "FROM scores WHERE prediction IN (1, 2)) q WHERE rank <= 2000",
        "recommend_by_class_scores": _with(_PRODUCTS) + "SELECT ID, Type, EI FROM products WHERE EI IN (1, 2)",
        "distinct_values": _with(_PRODUCTS) + "SELECT DISTINCT Washing_instruction FROM products",
        "frequency_table": _with(_PRODUCTS)
        + "SELECT Manufacturing_location, COUNT(*) AS count FROM products GROUP BY 1 ORDER BY 1 NULLS FIRST",
        "frequency_of_dummy": _with(_ENCODED)
        + "SELECT Manufacturing_location_Unknown, COUNT(*) AS count FROM encoded GROUP BY 1 ORDER BY 1",
        "corr_pair_zero": _with(_GAPPY)
        + "SELECT ROUND(CORR(COALESCE(quantity, 0), COALESCE(price, 0)), 6) AS corr FROM gappy",
        "corr_pair_pairwise": _with(_GAPPY) + "SELECT ROUND(CORR(quantity, price), 6) AS corr FROM gappy",
        "corr_matrix": _with(_ENCODED) + _corr_matrix("encoded", _ENCODED_NUMBERS),
        "corr_matrix_pairwise": _with(_GAPPY)
        + _corr_matrix("gappy", ["quantity", "price", "discount", "tax", "constant"]),
        "chi_square_table": _with(_PRODUCTS, _chi_square("products", [*_STRINGS, "Material_label"], "EI")),
        "chi_square_lines": _with(_chi_square("lineitem", ["l_linenumber", "l_discount", "l_tax"], "l_returnflag")),
        "dummy_encode": _with(_ENCODED) + "SELECT * FROM encoded",
        "reduced_feature_set": _with(_ENCODED)
        + "SELECT * EXCLUDE (Drying_instruction_Linedry, Drying_instruction_Dryclean, Drying_instruction_Tumble) FROM encoded",
        "string_index_keep": _with(_PRODUCTS, *index_parts)
        + "SELECT ID, Manufacturing_location, Drying_instruction, "
        + ", ".join(f"COALESCE(ix_{c}.i, (SELECT CAST(COUNT(*) AS DOUBLE) FROM ix_{c})) AS {c}_index" for c in indexed)
        + f" FROM products {joins}",
        "string_index_skip": _with(_PRODUCTS, *index_parts)
        + "SELECT ID, Manufacturing_location, Drying_instruction, "
        + ", ".join(f"ix_{c}.i AS {c}_index" for c in indexed)
        + f" FROM products {joins.replace('LEFT JOIN', 'JOIN')}",
        "one_hot": _with(_PRODUCTS) + "SELECT ID, Type, Drying_instruction, "
        + ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for c in ("Type", "Drying_instruction") for n, e in _hot(c).items())
        + " FROM products",
        "assemble_array": _with(_PRODUCTS)
        + "SELECT ID, Cotton AS slot_0, Polyester AS slot_1, Elastane AS slot_2, CAST(Material_label AS DOUBLE) AS slot_3 FROM products",
        "standard_scale": _with(_PRODUCTS, "sd AS (SELECT STDDEV_SAMP(Cotton) AS a, STDDEV_SAMP(Polyester) AS b, STDDEV_SAMP(Transporation_distance) AS c FROM products)")
        + "SELECT ID, ROUND(Cotton / a, 6) AS Cotton, ROUND(Polyester / b, 6) AS Polyester, "
        + "ROUND(Transporation_distance / c, 6) AS Transporation_distance, CAST(0 AS DOUBLE) AS no_spread FROM products, sd",
        "selected_feature_names": _with(_SELECTED) + "SELECT feature FROM picked",
        "chi_square_select": _with(_SELECTED)
        + "SELECT slots.feature, CAST(SUM(value) AS BIGINT) AS n_set FROM slots JOIN picked ON picked.feature = slots.feature GROUP BY slots.feature",
        "pca_reconstruction": _with(_ENCODED) + _corr_matrix("encoded", [*_NUMBERS, *_DUMMIES], diagonal=True),
        "cumulative_variance": _with(_EIGEN)
        + "SELECT component, ROUND(ratio, 6) AS ratio, ROUND(cumulative, 6) AS cumulative FROM running",
        "wide_cumulative_variance": _with(_EIGEN)
        + "SELECT component, ROUND(ratio, 6) AS ratio, ROUND(cumulative, 6) AS cumulative FROM running",
        "pca_index_scores": _with(_PRODUCTS, *[_index("products", c) for c in _STRINGS], f"""indexed AS (SELECT ID, {", ".join(
            f"COALESCE(ix_{c}.i, (SELECT COUNT(*) FROM ix_{c})) AS {c}" for c in _STRINGS
        )} FROM products {" ".join(f"LEFT JOIN ix_{c} ON ix_{c}.v = products.{c}" for c in _STRINGS)})""")
        + "SELECT ID, ROUND(SQRT(" + " + ".join(
            f"POW(COALESCE({c} / NULLIF((SELECT STDDEV_SAMP({c}) FROM indexed), 0), 0), 2)" for c in _STRINGS
        ) + "), 6) AS length FROM indexed",
        "components_needed": _with(_EIGEN) + "SELECT MIN(component) AS k FROM running WHERE cumulative >= 0.95",
        "keyed_split": _with(_PRODUCTS)
        + f"SELECT ID, CASE WHEN {_KEY_BUCKET} < {_FOUR_FIFTHS} THEN 0 ELSE 1 END AS part FROM products",
        "random_split_whole": _with(_PRODUCTS) + "SELECT COUNT(ID) AS n_rows, COUNT(DISTINCT ID) AS n_products FROM products",
        "confusion_matrix": _with(_SCORES)
        + "SELECT CAST(EI AS DOUBLE) AS label, prediction, COUNT(*) AS n FROM scores GROUP BY ALL",
        "hit_indicator": _with(_SCORES)
        + "SELECT ID, CAST(prediction = EI AS DOUBLE) AS hit, CAST(EI = 1 AS DOUBLE) AS is_first FROM scores",
        "class_metrics": _with(_SCORES, _CONFUSION)
        + "SELECT label, tp, predicted, support, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM scored",
        "classification_metrics": _with(_SCORES, _CONFUSION)
        + "SELECT ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS accuracy, "
        + "ROUND(SUM(precision * support) / SUM(support), 6) AS weighted_precision, "
        + "ROUND(SUM(recall * support) / SUM(support), 6) AS weighted_recall, "
        + "ROUND(SUM(f1 * support) / SUM(support), 6) AS f1, "
        + "ROUND(1 - CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS test_error FROM scored",
        "roc_curve": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5])) + _ROC,
        "roc_hard_label": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5], "CAST(prediction = {} AS DOUBLE)")) + _ROC,
        "roc_curve_lines": _with(_LINE_SCORES, _points("line_scores", [1, 2, 3])) + _ROC,
        "roc_curve_corners": _with(_LINE_SCORES, _points("line_scores", [1, 2, 3])) + _CORNERS,
        "roc_product_corners": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5])) + _CORNERS,
        "profile_top_values": _top_values("lineitem", _LINE_COLUMNS, 0.01),
        "profile_histograms": _histograms("lineitem", _LINE_NUMBERS, 12),
        "auc_per_class": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5]), _AUC) + "SELECT label, ROUND(auc, 6) AS auc FROM areas",
        "auc_lines": _with(_LINE_SCORES, _points("line_scores", [1, 2, 3]), _AUC) + "SELECT label, ROUND(auc, 6) AS auc FROM areas",
        "auc_mean": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5]), _AUC)
        + "SELECT ROUND(AVG(auc), 6) AS mean_auc, COUNT(auc) AS n_classes FROM areas",
        "auc_hard_label": _with(_SCORES, _points("scores", [1, 2, 3, 4, 5], "CAST(prediction = {} AS DOUBLE)"), _AUC)
        + "SELECT label, ROUND(auc, 6) AS auc FROM areas",
        "csv_rejected_rows": """SELECT CASE WHEN o_orderkey % 97 = 7 OR o_orderkey % 101 = 3 THEN 'rejected' ELSE 'kept' END AS kind,
  o_orderkey AS key, CASE WHEN o_orderkey % 97 = 7 THEN 'n/a' WHEN o_orderkey % 101 = 3
    THEN CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) ELSE o_orderpriority END AS shown FROM orders""",
        "tree_nodes": _with(_PRODUCTS, f"""ends AS (
  SELECT EI, MIN(Cotton) AS low, MAX(Cotton) AS high FROM products WHERE {_KEY_BUCKET} < {_FOUR_FIFTHS} GROUP BY EI)""")
        + "SELECT 'Cotton' AS feature, ROUND((a.low + b.high) / 2, 6) AS threshold FROM ends a JOIN ends b ON b.EI = a.EI + 1",
        "tree_leaves": _separable(),
        "tune_folds": _with(_PRODUCTS, f"""parts AS (SELECT CAST(FLOOR({_KEY_BUCKET} / 1073741824) AS INT) AS fold FROM products)""")
        + "SELECT fold, COUNT(*) AS n_rows, CAST(1 AS DOUBLE) AS accuracy FROM parts GROUP BY fold",
        "tune_adaptive": _with(_PRODUCTS)
        + f"SELECT 20 AS n_trials, CAST(1 AS DOUBLE) AS best_accuracy, COUNT(*) AS n_rated FROM products WHERE {_KEY_BUCKET} >= {_FOUR_FIFTHS}",
        "decision_tree_separable": _separable(),
        "random_forest_separable": _separable(),
        "one_vs_rest_separable": _separable(),
        "importances_separable": _with(_ENCODED) + _union([
            f"SELECT '{f}' AS feature, CAST({1 if f == 'Cotton' else 0} AS DOUBLE) AS importance"
            for f in ["TypeIndex", "Use_locationIndex", *_NUMBERS, *_DUMMIES]
        ]),
        "top_importances_separable": "SELECT 'Cotton' AS feature",
        "evaluation_separable": _with(_PRODUCTS, f"held_out AS (SELECT EI FROM products WHERE {_KEY_BUCKET} >= {_FOUR_FIFTHS})")
        + _union([
            f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value"
            for m, v in [("accuracy", 1), ("weighted_precision", 1), ("weighted_recall", 1), ("f1", 1), ("test_error", 0), ("least_auc", 1)]
        ])
        + " UNION ALL SELECT 'n_classes' AS metric, CAST(COUNT(DISTINCT EI) AS DOUBLE) AS value FROM held_out",
        "decision_tree_double_features": _union([
            f"SELECT {i} AS position, '{stage}' AS stage, '{column}' AS input_column"
            for i, stage, column in [
                (0, "StringIndexerModel", "Type"),
                (1, "StringIndexerModel", "Use_location"),
                *[(2, "VectorAssembler", c) for c in ["TypeIndex", "Use_locationIndex", *_NUMBERS[:4]]],
                (3, "DecisionTreeClassificationModel", "features"),
            ]
        ]),
        "skipped_rows": _with(_PRODUCTS)
        + "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE Drying_instruction IS NULL OR Manufacturing_location IS NULL) AS n_skipped FROM products",
        "recommend_by_probability": _with(_SCORES)
        + f"SELECT ID, Type, EI, {_SLOT_COLUMNS} FROM scores WHERE prediction IN (1, 2) ORDER BY {_SCORE_ORDER}",
        "recommend_by_class": _with(_SCORES)
        + "SELECT ID, Type, prediction, EI FROM scores WHERE prediction IN (1, 2) ORDER BY prediction, ID LIMIT 20",
        "recommend_for_type": _with(_SCORES)
        + f"SELECT ID, Type, EI, {_SLOT_COLUMNS} FROM scores WHERE prediction IN (1, 2) AND Type = 'promo' ORDER BY {_SCORE_ORDER} LIMIT 20",
        "recommend_top_n_per_type": _with(_SCORES)
        + f"SELECT * FROM (SELECT ID, Type, EI, {_SLOT_COLUMNS}, CAST(ROW_NUMBER() OVER (PARTITION BY Type ORDER BY {_SCORE_ORDER}) AS INT) AS rank "
        + "FROM scores WHERE prediction IN (1, 2)) q WHERE rank <= 10",
        "recommend_all_per_type": _with(_SCORES)
        + f"SELECT ID, Type, EI, {_SLOT_COLUMNS}, CAST(ROW_NUMBER() OVER (PARTITION BY Type ORDER BY {_SCORE_ORDER}) AS INT) AS rank "
        + "FROM scores WHERE prediction IN (1, 2)",
        "recommend_from_tree": _with(_PRODUCTS)
        + "SELECT ID, Type, EI, " + ", ".join(f"CAST(EI = {k} AS DOUBLE) AS p{k}" for k in range(1, 6))
        + " FROM products WHERE EI IN (1, 2) AND Type = 'promo' ORDER BY EI, ID LIMIT 20",
        "recommend_from_boosting": _with(_PRODUCTS)
        + "SELECT ID, Type, CAST(EI AS DOUBLE) AS prediction, EI FROM products WHERE EI IN (1, 2) ORDER BY EI, ID LIMIT 20",
    }
