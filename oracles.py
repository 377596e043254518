"""DuckDB SQL for each registered query, written apart from the Spark code."""

from __future__ import annotations

from binroute.constants import CARD_TYPE_CODES, CURRENCY_CODES, ERROR_BLACKLIST, IS_3D_CODES, STATUS_CODES
from binroute.fixtures import AS_OF, EXTERNAL, PROCESSOR_SEED

COLUMNS = ("merchant", "card_type", "status", "is_3d", "currency", "processor_name", "project_name")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ERRORS = ", ".join(_text(e) for e in ERROR_BLACKLIST)
EXTERNALS = ", ".join(_text(e) for e in EXTERNAL)

PROC = """CASE WHEN l_partkey % 89 = 7 THEN NULL WHEN l_orderkey < 3 THEN concat('RARE-', CAST(l_suppkey % 3 AS VARCHAR))
     WHEN l_suppkey % 20 < 2 THEN concat('EXT-', CAST(l_suppkey % 20 AS VARCHAR))
     ELSE concat('PROC-', lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0')) END"""
STAT = """CASE WHEN l_partkey % 97 = 5 THEN NULL WHEN l_returnflag = 'A' AND o_custkey % 7 <> 0 THEN 'approved'
     WHEN l_returnflag = 'N' THEN 'filtered' ELSE 'declined' END"""

TRANSACTIONS = f"""transactions AS (
  SELECT l_orderkey AS txid, {PROC} AS processor_name, {STAT} AS status,
         CASE WHEN l_partkey % 100 < {len(ERROR_BLACKLIST)} THEN ([{ERRORS}])[l_partkey % 100 + 1]
              WHEN l_partkey % 100 < 45 THEN NULL WHEN l_partkey % 100 < 55 THEN '' ELSE 'Do not honor' END AS error_description,
         CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS created_datetime,
         CAST(l_shipdate AS DATE) AS created_date
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
CARDS = """card_customers AS (
  SELECT o_orderkey AS txid, CASE WHEN o_orderkey % 101 = 0 THEN '4000' ELSE
         concat(CAST(400000 + (o_custkey + nth) % 70 AS VARCHAR), lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) END AS card_no
  FROM orders CROSS JOIN (VALUES (0), (1)) v(nth) WHERE nth = 0 OR o_orderkey % 9 = 0)"""
BLACKLIST = f"error_blacklist AS (SELECT unnest([{ERRORS}]) AS error_description)"
TRAINING = f"""training AS (
  SELECT CASE WHEN o_custkey % 71 <> 3 THEN CAST(400000 + o_custkey % 70 AS BIGINT) END AS bin, concat('M-', CAST(c_nationkey AS VARCHAR)) AS merchant,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS card_type, {STAT} AS status,
         CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 't' END AS is_3d,
         CASE l_linenumber % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency,
         {PROC} AS processor_name, c_mktsegment AS project_name, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE (o_custkey % 70 + l_suppkey % 20) % 11 <> 0)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (TRANSACTIONS, CARDS, BLACKLIST)
PREVIOUS_MONTH = (
    f"t.created_date >= date_trunc('month', DATE '{AS_OF}' - INTERVAL 1 MONTH) "
    f"AND t.created_date < date_trunc('month', DATE '{AS_OF}')"
)


def _percent(success: str, total: str, digits: int) -> str:
    """Rounded half up in whole-number arithmetic."""
    scale = 10**digits
    return (
        f"CAST((2 * {success} * {100 * scale} + {total}) // NULLIF(2 * {total}, 0) AS DOUBLE) / {scale}.0"
    )


COUNTS = """CAST(COUNT(*) FILTER (WHERE status IN ('approved', 'declined')) AS BIGINT) AS total,
         CAST(COUNT(*) FILTER (WHERE status = 'approved') AS BIGINT) AS total_success"""


# --- R2 --------------------------------------------------------------------------


def _bin_stats(as_of: str, legacy: bool = False, where: str | None = None) -> tuple[str, ...]:
    keep = (
        f"b.error_description NOT IN ({ERRORS})"
        if legacy
        else "NOT EXISTS (SELECT 1 FROM error_blacklist e WHERE e.error_description = b.error_description)"
    )
    return (
        *BASE,
        f"""base AS (SELECT * FROM transactions WHERE {where or f"created_date >= DATE '{as_of}' - INTERVAL 1 MONTH"})""",
        "first_times AS (SELECT txid, MIN(created_datetime) AS ts FROM base GROUP BY txid)",
        f"""first_tx AS (SELECT b.txid, b.processor_name, b.status FROM base b
  JOIN first_times f ON b.txid = f.txid AND b.created_datetime = f.ts WHERE {keep})""",
        f"""counts AS (SELECT left(c.card_no, 6) AS bin, processor_name, {COUNTS}
  FROM first_tx f JOIN card_customers c ON c.txid = f.txid GROUP BY 1, 2)""",
        f"stats AS (SELECT *, {_percent('total_success', 'total', 4)} AS approval_rate FROM counts)",
    )


# --- R1 --------------------------------------------------------------------------

FIRST_USABLE = (
    "first_times AS (SELECT txid, MIN(created_datetime) AS ts FROM usable GROUP BY txid)",
    """first_tx AS (SELECT txid, processor_name, status FROM (
    SELECT u.*, ROW_NUMBER() OVER (PARTITION BY u.txid, u.processor_name
                                   ORDER BY u.created_datetime, u.status NULLS LAST) AS rn
    FROM usable u JOIN first_times f ON u.txid = f.txid AND u.created_datetime = f.ts) WHERE rn = 1)""",
)


def _usable(start: str, end: str) -> str:
    return f"""usable AS (SELECT * FROM transactions
  WHERE created_date BETWEEN DATE '{start}' AND DATE '{end}' AND error_description NOT IN ({ERRORS}))"""


def _ranked(start: str, end: str, bins: str | None = None) -> tuple[str, ...]:
    where = f"WHERE left(c.card_no, 6) IN ({bins})" if bins else ""
    return (
        *BASE,
        _usable(start, end),
        *FIRST_USABLE,
        f"""counts AS (SELECT left(c.card_no, 6) AS bin, processor_name AS processor, {COUNTS}
  FROM first_tx f JOIN card_customers c ON c.txid = f.txid {where} GROUP BY 1, 2)""",
        _RANK,
    )


_RANK = f"""ranked AS (SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY bin ORDER BY ar DESC NULLS FIRST) AS BIGINT) AS rnk
  FROM (SELECT *, {_percent('total_success', 'total', 3)} AS ar FROM counts))"""

STATE_RANGE = ("1996-03-10", "2000-08-20")
WHOLE = ("1995-01-01", "2001-12-31")
YEAR = ("2000-01-01", "2000-12-31")
SELECTED = "'400001', '400002', '400003', '400007'"

TEXT_BINS = ("012345", "AB12CD", "40")
LETTERED = """card_customers AS (
  SELECT o_orderkey AS txid, concat(CASE o_custkey % 4 WHEN 0 THEN '012345' WHEN 1 THEN 'AB12CD' WHEN 2 THEN '40' ELSE '400001' END,
    CASE WHEN o_custkey % 4 = 2 THEN '' ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END) AS card_no FROM orders)"""

REPORT = (
    *_ranked(*WHOLE),
    f"""report AS (SELECT CAST(CAST(bin AS BIGINT) AS VARCHAR) AS "BIN", trim(processor) AS "Processor",
    COALESCE(total, 0) AS "Total Transactions", COALESCE(total_success, 0) AS "Total Success",
    COALESCE(ar, 0.0) AS "Approval Rate (%)", rnk AS "Rank",
    CASE WHEN trim(processor) IN ({EXTERNALS}) THEN 'Yes' ELSE 'No' END AS "Fallback External" FROM ranked)""",
)


def _legacy_ranked() -> tuple[str, ...]:
    return (
        *BASE,
        _usable(*YEAR),
        "first_times AS (SELECT txid, MIN(created_datetime) AS ts FROM usable GROUP BY txid)",
        """first_transaction AS (SELECT DISTINCT t.txid, t.processor_name, t.created_datetime
  FROM transactions t JOIN first_times f ON t.txid = f.txid AND t.created_datetime = f.ts)""",
        f"""counts AS (SELECT left(c.card_no, 6) AS bin, t.processor_name AS processor, {COUNTS}
  FROM transactions t JOIN first_transaction f ON t.txid = f.txid AND t.processor_name = f.processor_name
    AND t.created_datetime = f.created_datetime
  JOIN card_customers c ON c.txid = t.txid GROUP BY 1, 2)""",
        _RANK,
    )


# --- dictionaries ------------------------------------------------------------------

SEED_CODES = {
    "status": STATUS_CODES,
    "is_3d": IS_3D_CODES,
    "currency": CURRENCY_CODES,
    "card_type": CARD_TYPE_CODES,
    "processor_name": PROCESSOR_SEED,
}
_SEED_ROWS = ", ".join(
    f"({_text(column)}, {_text(category)}, {code})"
    for column, codes in SEED_CODES.items()
    for category, code in codes.items()
)
DICTIONARY = (
    TRAINING,
    f"seed AS (SELECT * FROM (VALUES {_SEED_ROWS}) v(column_name, category, code))",
    "profile AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS category, COUNT(*) AS n FROM training WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in COLUMNS
    )
    + ")",
    """modes AS (SELECT column_name, category AS mode FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, category) AS rn FROM profile) WHERE rn = 1)""",
    """largest AS (SELECT column_name, MAX(code) AS largest FROM seed GROUP BY column_name)""",
    """unseen AS (SELECT p.column_name, p.category,
    ROW_NUMBER() OVER (PARTITION BY p.column_name ORDER BY p.category) AS rn
  FROM profile p LEFT JOIN seed s ON s.column_name = p.column_name AND s.category = p.category
  WHERE s.category IS NULL)""",
    """dictionary AS (SELECT column_name, category, CAST(code AS INTEGER) AS code FROM seed
  UNION ALL SELECT u.column_name, u.category, CAST(COALESCE(l.largest, -1) + u.rn AS INTEGER)
  FROM unseen u LEFT JOIN largest l ON l.column_name = u.column_name)""",
)


def _mode(column: str) -> str:
    return f"(SELECT mode FROM modes WHERE column_name = '{column}')"


ENCODED = (
    *DICTIONARY,
    "encoded AS (SELECT bin, l_orderkey, l_linenumber, "
    + ", ".join(f"d_{c}.code AS {c}_encoded" for c in COLUMNS)
    + " FROM training t "
    + " ".join(
        f"JOIN dictionary d_{c} ON d_{c}.column_name = '{c}' AND d_{c}.category = COALESCE(t.{c}, {_mode(c)})"
        for c in COLUMNS
    )
    + ")",
    """labelled AS (SELECT *, CAST(CASE WHEN status_encoded = 0 THEN 1 ELSE 0 END AS INTEGER) AS success_flag,
    bin // 1000 AS bin_prefix, bin % 1000 AS bin_suffix FROM encoded)""",
)


def _stats(require_success: bool) -> tuple[str, ...]:
    keep = (
        "SELECT * FROM labelled WHERE bin IN (SELECT bin FROM labelled GROUP BY bin HAVING AVG(success_flag) > 0)"
        if require_success
        else "SELECT * FROM labelled WHERE bin IS NOT NULL"
    )
    return (
        *ENCODED,
        f"good AS ({keep})",
        """kept AS (SELECT * FROM good WHERE processor_name_encoded IN (
    SELECT processor_name_encoded FROM good GROUP BY 1 HAVING COUNT(*) >= 10))""",
        """bin_tx AS (SELECT bin, COUNT(*) AS bin_tx_count FROM kept GROUP BY bin)""",
        """bin_success AS (SELECT bin, CAST(SUM(success_flag) AS DOUBLE) / COUNT(*) AS bin_success_rate
  FROM kept GROUP BY bin)""",
        """proc_success AS (SELECT processor_name_encoded,
    CAST(SUM(success_flag) AS DOUBLE) / COUNT(*) AS processor_success_rate FROM kept GROUP BY 1)""",
        """bin_proc AS (SELECT bin, processor_name_encoded, COUNT(*) AS bin_processor_tx_count,
    CAST(SUM(success_flag) AS BIGINT) AS bin_processor_success_count,
    CAST(SUM(success_flag) AS DOUBLE) / COUNT(*) AS bin_processor_success_rate FROM kept GROUP BY 1, 2)""",
        """features AS (SELECT k.l_orderkey, k.l_linenumber, k.processor_name_encoded, k.success_flag,
    k.bin, k.bin_prefix, k.bin_suffix, k.is_3d_encoded, t.bin_tx_count, s.bin_success_rate, p.processor_success_rate,
    bp.bin_processor_tx_count, bp.bin_processor_success_count, bp.bin_processor_success_rate
  FROM kept k JOIN bin_tx t ON t.bin = k.bin JOIN bin_success s ON s.bin = k.bin
  JOIN proc_success p ON p.processor_name_encoded = k.processor_name_encoded
  JOIN bin_proc bp ON bp.bin = k.bin AND bp.processor_name_encoded = k.processor_name_encoded)""",
        """fallback AS (SELECT t.*, s.*, p.* FROM (SELECT AVG(bin_tx_count) AS bin_tx_count FROM bin_tx) t,
    (SELECT AVG(bin_success_rate) AS bin_success_rate FROM bin_success) s,
    (SELECT AVG(bin_processor_tx_count) AS bin_processor_tx_count,
            AVG(bin_processor_success_count) AS bin_processor_success_count,
            AVG(bin_processor_success_rate) AS bin_processor_success_rate FROM bin_proc) p)""",
    )


RETRAIN, NOTEBOOK = _stats(True), _stats(False)

BINS = f"""bins AS (SELECT DISTINCT CAST(left(card_no, 6) AS BIGINT) AS bin FROM card_customers
  UNION SELECT 999999)"""
CODE_3D = IS_3D_CODES["t"]

_CANDIDATE_KEYS = f"""b.bin, p.processor_name_encoded, b.bin // 1000 AS bin_prefix, b.bin % 1000 AS bin_suffix,
    CAST({CODE_3D} AS INTEGER) AS is_3d_encoded"""
_CANDIDATE_FROM = """FROM bins b CROSS JOIN proc_success p LEFT JOIN bin_tx t ON t.bin = b.bin
  LEFT JOIN bin_success s ON s.bin = b.bin
  LEFT JOIN bin_proc bp ON bp.bin = b.bin AND bp.processor_name_encoded = p.processor_name_encoded"""
CANDIDATES = (
    *RETRAIN,
    CARDS,
    BINS,
    f"""candidates AS (SELECT {_CANDIDATE_KEYS},
    ROUND(CASE WHEN t.bin IS NULL THEN f.bin_tx_count ELSE t.bin_tx_count END, 6) AS bin_tx_count,
    ROUND(CASE WHEN t.bin IS NULL THEN f.bin_success_rate ELSE COALESCE(s.bin_success_rate, 0) END, 6) AS bin_success_rate,
    ROUND(COALESCE(p.processor_success_rate, 0), 6) AS processor_success_rate,
    ROUND(COALESCE(bp.bin_processor_tx_count, f.bin_processor_tx_count), 6) AS bin_processor_tx_count,
    ROUND(COALESCE(bp.bin_processor_success_count, f.bin_processor_success_count), 6) AS bin_processor_success_count,
    ROUND(COALESCE(bp.bin_processor_success_rate, f.bin_processor_success_rate), 6) AS bin_processor_success_rate
  {_CANDIDATE_FROM} CROSS JOIN fallback f)""",
)
CANDIDATES_NB = (
    *NOTEBOOK,
    CARDS,
    BINS,
    f"""candidates AS (SELECT {_CANDIDATE_KEYS},
    CAST(COALESCE(t.bin_tx_count, 0) AS DOUBLE) AS bin_tx_count,
    ROUND(COALESCE(s.bin_success_rate, 0), 6) AS bin_success_rate,
    ROUND(COALESCE(p.processor_success_rate, 0), 6) AS processor_success_rate,
    CAST(COALESCE(bp.bin_processor_tx_count, 0) AS DOUBLE) AS bin_processor_tx_count,
    CAST(COALESCE(bp.bin_processor_success_count, 0) AS DOUBLE) AS bin_processor_success_count,
    ROUND(COALESCE(bp.bin_processor_success_rate, 0), 6) AS bin_processor_success_rate
  {_CANDIDATE_FROM})""",
)
_SCORED_CANDIDATES = """scored AS (SELECT c.bin, c.processor_name_encoded, c.bin_processor_success_rate AS score,
    COALESCE(d.category, concat('Unknown ID ', CAST(c.processor_name_encoded AS VARCHAR))) AS processor
  FROM candidates c LEFT JOIN dictionary d
    ON d.column_name = 'processor_name' AND d.code = c.processor_name_encoded)"""
TOP = f"""top AS (SELECT CAST(bin AS VARCHAR) AS "BIN", processor AS "Processor", pct AS "Predicted Success %",
    CAST(rn AS BIGINT) AS "Rank", CASE WHEN processor IN ({EXTERNALS}) THEN 'Yes' ELSE 'No' END AS "Fallback External"
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY pct DESC, processor_name_encoded) AS rn
        FROM (SELECT *, round_even(score * 100, 2) AS pct FROM scored) WHERE pct >= 0.0) WHERE rn <= 5000)"""


# --- evaluation ------------------------------------------------------------------

SCORED = (
    *RETRAIN,
    """scored AS (SELECT success_flag AS label, bin_processor_success_rate AS score,
    CAST(CASE WHEN bin_processor_success_rate >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM features)""",
)
POINTS = (
    *SCORED,
    """points AS (SELECT score, pos, neg,
    SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp,
    SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
  FROM (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score))""",
)
CLASSES = (
    *SCORED,
    """classes AS (SELECT c, COALESCE(CAST(hit AS DOUBLE) / NULLIF(guessed, 0), 0) AS precision,
    COALESCE(CAST(hit AS DOUBLE) / NULLIF(support, 0), 0) AS recall,
    COALESCE(2.0 * hit / NULLIF(guessed + support, 0), 0) AS f1, support, hit
  FROM (SELECT c, COUNT(*) FILTER (WHERE label = c AND prediction = c) AS hit,
               COUNT(*) FILTER (WHERE prediction = c) AS guessed, COUNT(*) FILTER (WHERE label = c) AS support
        FROM scored CROSS JOIN (VALUES (0), (1)) v(c) GROUP BY c))""",
)

SPLIT_KEY = (
    "(l_orderkey % 2147483647 * 1000003 + l_linenumber * 7919 + processor_name_encoded * 97 + success_flag * 31)"
    " % 4294967291"
)
SPLIT = (
    *RETRAIN,
    """sizes AS (SELECT success_flag, COUNT(*) AS n FROM features GROUP BY 1)""",
    """shares AS (SELECT success_flag, n, CAST(SUM(n) OVER () AS BIGINT) AS total,
    CAST(SUM(n) OVER () - CEIL(0.2::DOUBLE * SUM(n) OVER ()) AS BIGINT) AS kept FROM sizes)""",
    """floors AS (SELECT *, n * kept // total AS base, n * kept % total AS remainder FROM shares)""",
    """quotas AS (SELECT success_flag, n - base - CASE WHEN ROW_NUMBER() OVER (ORDER BY remainder DESC, success_flag)
    <= kept - SUM(base) OVER () THEN 1 ELSE 0 END AS quota FROM floors)""",
    f"""split AS (SELECT f.l_orderkey, f.l_linenumber, f.bin, f.processor_name_encoded, f.success_flag,
    ROW_NUMBER() OVER (PARTITION BY f.success_flag ORDER BY {SPLIT_KEY.replace('success_flag', 'f.success_flag')})
      <= q.quota AS is_holdout
  FROM features f JOIN quotas q ON q.success_flag = f.success_flag)""",
)

# --- BIN input -------------------------------------------------------------------

TEXT_TOKENS = """tokens AS (SELECT trim(unnest(string_split(concat(CAST(400000 + o_custkey % 70 AS VARCHAR), ', ',
    CAST(o_orderkey AS VARCHAR), ',', lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0'), ' ,x', o_orderstatus), ','))) AS token
  FROM orders),
parsed AS (SELECT token, CASE WHEN regexp_full_match(token, '[0-9]{6}') THEN CAST(token AS BIGINT) END AS bin FROM tokens)"""
CSV_TOKENS = """tokens AS (SELECT CASE o_custkey % 6 WHEN 0 THEN CAST(400000 + o_custkey % 70 AS VARCHAR)
    WHEN 1 THEN concat(CAST(400000 + o_custkey % 70 AS VARCHAR), '.0')
    WHEN 2 THEN lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0')
    WHEN 3 THEN concat('-', CAST(o_custkey AS VARCHAR)) WHEN 4 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS token
  FROM orders),
parsed AS (SELECT token, CASE WHEN regexp_full_match(token, '[0-9]+([.]0*)?')
    AND length(CAST(CAST(split_part(token, '.', 1) AS BIGINT) AS VARCHAR)) = 6
    THEN CAST(split_part(token, '.', 1) AS BIGINT) END AS bin FROM tokens)"""
BIN_LIST = "SELECT bin, COUNT(*) AS times FROM parsed WHERE bin IS NOT NULL GROUP BY bin"
BIN_COUNTS = """SELECT COUNT(DISTINCT bin) AS valid, COUNT(bin) - COUNT(DISTINCT bin) AS duplicate,
  COUNT(*) - COUNT(bin) AS invalid FROM parsed"""

DAMAGED = (
    "lines AS (SELECT l_orderkey % 13 AS kind, concat_ws(',', CASE WHEN l_orderkey % 13 = 3 THEN concat('x', "
    "CAST(l_linenumber AS VARCHAR)) ELSE COALESCE(CAST(bin AS VARCHAR), '') END, "
    + ", ".join(f"COALESCE({c}, '')" for c in COLUMNS)
    + ") AS line FROM training)"
)
TRAINING_COLUMNS = ("bin", *COLUMNS, "l_orderkey", "l_linenumber")
ANTI = "NOT EXISTS (SELECT 1 FROM error_blacklist e WHERE e.error_description = t.error_description)"
NOT_IN = f"t.error_description NOT IN ({ERRORS})"
ATTEMPT = (
    "txid, processor_name, status, error_description, created_datetime, "
    "CAST(created_date AS VARCHAR) AS created_date"
)


def _routed(threshold: float) -> str:
    good = f"processor NOT IN ({EXTERNALS}) AND score >= {threshold}"
    return f"""SELECT bin, processor, score AS predicted_success, CAST(rn AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY score DESC, processor_name_encoded) AS rn FROM scored
  WHERE ({good}) OR (processor IN ({EXTERNALS}) AND bin NOT IN (SELECT bin FROM scored WHERE {good}))) WHERE rn <= 3"""


def oracle_sql() -> dict[str, str]:
    stats_columns = "SELECT bin, processor_name, total, total_success, approval_rate FROM stats"
    ranked_columns = "SELECT bin, processor, total, total_success, ar, rnk FROM ranked"
    correlated = [f"{c}_encoded" for c in COLUMNS if c != "project_name"] + ["bin"]
    return {
        # approval rates
        "approval_rate_ranked": _with(*_ranked(*WHOLE)) + ranked_columns,
        "approval_rate_selected": _with(*_ranked(*YEAR, SELECTED)) + ranked_columns,
        "approval_rate_text_bins": _with(
            *[LETTERED if part is CARDS else part for part in _ranked(*WHOLE, ", ".join(map(_text, TEXT_BINS)))]
        )
        + ranked_columns,
        "approval_rate_legacy": _with(*_legacy_ranked()) + ranked_columns,
        "bin_processor_stats": _with(*_bin_stats(AS_OF)) + stats_columns,
        "bin_processor_stats_all": _with(*_bin_stats(WHOLE[0])) + stats_columns,
        "bin_processor_stats_legacy": _with(*_bin_stats(WHOLE[0], legacy=True)) + stats_columns,
        "poor_pairs": _with(*_bin_stats(WHOLE[0]))
        + "SELECT bin, processor_name, total, total_success, approval_rate AS approval_rate_percent FROM stats "
        "WHERE approval_rate <= 30.0 AND total >= 5",
        "active_bins": _with(*BASE)
        + f"SELECT DISTINCT left(c.card_no, 6) AS bin FROM transactions t JOIN card_customers c ON c.txid = t.txid "
        f"WHERE {PREVIOUS_MONTH} AND {ANTI}",
        "active_bins_legacy": _with(*BASE)
        + f"SELECT DISTINCT left(c.card_no, 6) AS bin FROM transactions t LEFT JOIN card_customers c ON c.txid = t.txid "
        f"WHERE {PREVIOUS_MONTH} AND {NOT_IN}",
        "active_processors": _with(*BASE)
        + "SELECT DISTINCT t.processor_name FROM transactions t LEFT JOIN error_blacklist e "
        f"ON e.error_description = t.error_description WHERE {PREVIOUS_MONTH} AND e.error_description IS NULL",
        "active_processors_legacy": _with(*BASE)
        + f"SELECT DISTINCT t.processor_name FROM transactions t WHERE {PREVIOUS_MONTH} AND {NOT_IN}",
        # building blocks
        "blacklist_not_in": _with(*BASE) + f"SELECT {ATTEMPT} FROM transactions t WHERE {NOT_IN}",
        "blacklist_anti_join": _with(*BASE) + f"SELECT {ATTEMPT} FROM transactions t WHERE {ANTI}",
        "txn_with_bin": _with(*BASE)
        + "SELECT t.txid, left(c.card_no, 6) AS bin, processor_name, status "
        "FROM transactions t JOIN card_customers c ON c.txid = t.txid",
        "first_attempt_time": _with(*BASE)
        + "SELECT txid, MIN(created_datetime) AS first_transaction_datetime FROM transactions GROUP BY txid",
        "first_attempt_ties": _with(*BASE)
        + "SELECT t.txid, processor_name, status FROM transactions t JOIN (SELECT txid, MIN(created_datetime) AS ts "
        "FROM transactions GROUP BY txid) f ON f.txid = t.txid AND f.ts = t.created_datetime",
        "first_attempt_per_processor": _with(*BASE, "usable AS (SELECT * FROM transactions)", *FIRST_USABLE)
        + "SELECT txid, processor_name, status FROM first_tx",
        "first_attempt_state": _with(*BASE, "usable AS (SELECT * FROM transactions)", *FIRST_USABLE)
        + "SELECT txid, processor_name, status FROM first_tx",
        "bin_processor_stats_state": _with(
            *_bin_stats("", where=f"created_date BETWEEN DATE '{STATE_RANGE[0]}' AND DATE '{STATE_RANGE[1]}'")
        )
        + stats_columns,
        "approval_rate_layout": _with(*_ranked(*YEAR)) + ranked_columns,
        "bin_split": _with(TRAINING)
        + "SELECT l_orderkey, l_linenumber, bin, bin // 1000 AS bin_prefix, bin % 1000 AS bin_suffix FROM training",
        # report
        "report_ranked": _with(*REPORT) + "SELECT * FROM report",
        "report_reranked": _with(*REPORT)
        + 'SELECT * REPLACE (CAST(DENSE_RANK() OVER (PARTITION BY "BIN" ORDER BY "Approval Rate (%)" DESC) AS BIGINT) '
        'AS "Rank") FROM report',
        "processor_distribution": _with(*REPORT)
        + 'SELECT "Processor", "Fallback External", "Total Transactions", '
        'ROUND(AVG("Approval Rate (%)"), 6) AS "Approval Rate (%)" FROM report GROUP BY 1, 2, 3',
        "external_counts": _with(*REPORT)
        + """SELECT "Processor", COUNT(*) AS "Count" FROM report WHERE "Fallback External" = 'Yes' GROUP BY 1""",
        "internal_external_summary": _with(*REPORT)
        + """SELECT ROUND(COALESCE(AVG("Approval Rate (%)") FILTER (WHERE "Fallback External" = 'No'), 0), 6) AS avg_internal,
  ROUND(COALESCE(AVG("Approval Rate (%)") FILTER (WHERE "Fallback External" = 'Yes'), 0), 6) AS avg_external FROM report""",
        # BIN input
        "bin_input_text": "WITH " + TEXT_TOKENS + "\n" + BIN_LIST,
        "bin_input_text_counts": "WITH " + TEXT_TOKENS + "\n" + BIN_COUNTS,
        "bin_input_csv": "WITH " + CSV_TOKENS + "\n" + BIN_LIST,
        "bin_input_csv_counts": "WITH " + CSV_TOKENS + "\n" + BIN_COUNTS,
        # encoding
        "mode_impute": _with(*DICTIONARY)
        + "SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"COALESCE({c}, {_mode(c)}) AS {c}" for c in COLUMNS)
        + " FROM training",
        "column_modes": _with(*DICTIONARY) + "SELECT column_name, mode FROM modes",
        "extend_dictionary": _with(*DICTIONARY) + "SELECT column_name, category, code FROM dictionary",
        "encode_column": _with(*DICTIONARY)
        + "SELECT l_orderkey, l_linenumber, t.currency, d.code AS currency_encoded FROM training t "
        "LEFT JOIN dictionary d ON d.column_name = 'currency' AND d.category = t.currency",
        "encode_all": _with(*ENCODED) + "SELECT * FROM encoded",
        "decode_processor": _with(*ENCODED)
        + "SELECT l_orderkey, l_linenumber, processor_name_encoded, COALESCE(s.category, concat('Unknown ID ', "
        "CAST(processor_name_encoded AS VARCHAR))) AS processor FROM encoded LEFT JOIN seed s "
        "ON s.column_name = 'processor_name' AND s.code = processor_name_encoded",
        # statistics and features
        "successful_bins": _with(*ENCODED)
        + "SELECT bin FROM labelled WHERE bin IS NOT NULL GROUP BY bin HAVING AVG(success_flag) > 0",
        "valid_processors": _with(*RETRAIN)
        + "SELECT processor_name_encoded FROM good GROUP BY 1 HAVING COUNT(*) >= 10",
        "valid_processors_nb": _with(*ENCODED)
        + "SELECT processor_name_encoded FROM labelled WHERE bin IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 10",
        "all_processors": _with(*RETRAIN) + "SELECT DISTINCT processor_name_encoded FROM kept",
        "bin_tx": _with(*RETRAIN) + "SELECT * FROM bin_tx",
        "bin_success": _with(*RETRAIN) + "SELECT * FROM bin_success",
        "proc_success": _with(*RETRAIN) + "SELECT * FROM proc_success",
        "stats_merged": _with(*RETRAIN)
        + """SELECT bp.bin, d.category AS processor, t.bin_tx_count, s.bin_success_rate, p.processor_success_rate,
    bp.bin_processor_tx_count, bp.bin_processor_success_count, bp.bin_processor_success_rate
  FROM bin_proc bp JOIN bin_tx t ON t.bin = bp.bin JOIN bin_success s ON s.bin = bp.bin
  JOIN proc_success p ON p.processor_name_encoded = bp.processor_name_encoded
  JOIN dictionary d ON d.column_name = 'processor_name' AND d.code = bp.processor_name_encoded""",
        "bin_proc_stats": _with(*RETRAIN) + "SELECT * FROM bin_proc",
        "global_fallback": _with(*RETRAIN)
        + "SELECT ROUND(bin_tx_count, 6) AS bin_tx_count, ROUND(bin_success_rate, 6) AS bin_success_rate, "
        "ROUND(bin_processor_tx_count, 6) AS bin_processor_tx_count, "
        "ROUND(bin_processor_success_count, 6) AS bin_processor_success_count, "
        "ROUND(bin_processor_success_rate, 6) AS bin_processor_success_rate FROM fallback",
        "training_features": _with(*RETRAIN) + "SELECT * FROM features",
        "training_features_nb": _with(*NOTEBOOK) + "SELECT * FROM features",
        "candidate_features": _with(*CANDIDATES) + "SELECT * FROM candidates",
        "candidate_features_nb": _with(*CANDIDATES_NB) + "SELECT * FROM candidates",
        # split and profile
        "stratified_split": _with(*SPLIT) + "SELECT * FROM split",
        "class_ratio": _with(*SPLIT)
        + "SELECT CAST(COUNT(*) FILTER (WHERE success_flag = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE success_flag = 1) "
        "AS class_ratio FROM split WHERE NOT is_holdout",
        "null_profile": _with(TRAINING)
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS nulls, COUNT(*) AS row_count, "
            f"CAST({len(TRAINING_COLUMNS)} AS BIGINT) AS column_count FROM training"
            for c in TRAINING_COLUMNS
        ),
        "dedup_rows": _with(TRAINING) + "SELECT DISTINCT * FROM training",
        "dedup_profile": _with(TRAINING, "copies AS (SELECT DISTINCT * FROM training)")
        + "SELECT a.n AS row_count, b.n AS distinct_count, a.n - b.n AS duplicate_count "
        "FROM (SELECT COUNT(*) AS n FROM training) a, (SELECT COUNT(*) AS n FROM copies) b",
        "status_correlation": _with(*ENCODED)
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, ROUND(corr(CAST({c} AS DOUBLE), CAST(status_encoded AS DOUBLE)), 6) "
            "AS correlation FROM encoded"
            for c in correlated
        ),
        # evaluation
        "eval_accuracy": _with(*SCORED)
        + "SELECT CAST(COUNT(*) FILTER (WHERE label = prediction) AS DOUBLE) / COUNT(*) AS accuracy FROM scored",
        "eval_confusion": _with(*SCORED)
        + "SELECT label, prediction, COUNT(*) AS n FROM scored GROUP BY label, prediction",
        "eval_auc": _with(*POINTS)
        + "SELECT ROUND(SUM(CAST(pos AS DOUBLE) * (CAST(n - fp AS DOUBLE) + neg / 2.0)) / "
        "(CAST(MAX(p) AS DOUBLE) * MAX(n)), 6) AS auc FROM points",
        "eval_roc": _with(*POINTS)
        + "SELECT score AS threshold, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr FROM points "
        "UNION ALL SELECT NULL, 0.0, 0.0",
        "eval_pr": _with(*POINTS)
        + "SELECT score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / p AS recall "
        "FROM points UNION ALL SELECT NULL, 1.0, 0.0",
        "eval_report": _with(*CLASSES)
        + """SELECT class, ROUND(CAST(precision AS DOUBLE), 6) AS precision, ROUND(CAST(recall AS DOUBLE), 6) AS recall,
  ROUND(CAST(f1 AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support FROM (
    SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM classes
    UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT SUM(hit) / SUM(support) AS a, SUM(support) AS s FROM classes)
    UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM classes
    UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
      SUM(f1 * support) / SUM(support), SUM(support) FROM classes)""",
        # learning
        "gbt_scores": _with(*CANDIDATES) + "SELECT bin, processor_name_encoded, TRUE AS is_probability, TRUE AS agrees_with_nodes FROM candidates",
        "gbt_scores_unweighted": _with(*NOTEBOOK, CARDS, BINS)
        + "SELECT b.bin, p.processor_name_encoded, TRUE AS is_probability, TRUE AS agrees_with_nodes FROM bins b CROSS JOIN proc_success p",
        "training_accuracy": _with(*NOTEBOOK)
        + "SELECT CAST(COUNT(*) - CEIL(0.2::DOUBLE * COUNT(*)) AS BIGINT) AS training_rows, TRUE AS reaches_floor "
        "FROM features",
        # files
        "training_csv": _with(TRAINING)
        + "SELECT bin, CASE l_linenumber % 5 WHEN 0 THEN concat('He said \"hi\", ', merchant) "
        "WHEN 1 THEN concat('two', chr(10), 'lines, ', merchant) WHEN 4 THEN concat(' ', merchant, ' ') END AS merchant, "
        "card_type, status, is_3d, currency, processor_name, project_name FROM training",
        "training_csv_rejects": _with(TRAINING, DAMAGED)
        + f"""SELECT reason, record, COUNT(*) AS records FROM (
    SELECT 'fields' AS reason, concat(line, ',more') AS record FROM lines WHERE kind = 1
    UNION ALL SELECT 'fields', array_to_string(string_split(line, ',')[1:5], ',') FROM lines WHERE kind = 2
    UNION ALL SELECT 'bin', line FROM lines WHERE kind = 3 UNION ALL SELECT 'header', line FROM lines WHERE kind = 4
    UNION ALL SELECT 'header', '{','.join(reversed(('bin', *COLUMNS)))}' FROM range(3)) GROUP BY 1, 2""",
        "training_csv_kept": _with(TRAINING)
        + f"SELECT bin, {', '.join(COLUMNS)} FROM training WHERE l_orderkey % 13 NOT IN (1, 2, 3, 4)",
        "dictionary_json": _with(*DICTIONARY) + "SELECT column_name, category, code FROM dictionary",
        "report_csv": _with(*REPORT) + "SELECT * FROM report",
        # routing
        "top_processors": _with(*CANDIDATES, _SCORED_CANDIDATES, TOP)
        + 'SELECT * REPLACE (CAST("BIN" AS BIGINT) AS "BIN") FROM top',
        "route_internal_first": _with(*CANDIDATES_NB, _SCORED_CANDIDATES) + _routed(0.80),
        "route_internal_first_low": _with(*CANDIDATES_NB, _SCORED_CANDIDATES) + _routed(0.40),
        "predicted_vs_actual": _with(
            *CANDIDATES, _SCORED_CANDIDATES, TOP, *[part for part in REPORT if part not in CANDIDATES]
        )
        + """SELECT r."BIN", r."Processor", t."Predicted Success %", t."Rank" AS "Predicted Rank",
  r."Total Transactions", r."Total Success", r."Approval Rate (%)", r."Rank", r."Fallback External"
  FROM top t RIGHT JOIN report r ON r."BIN" = t."BIN" AND r."Processor" = t."Processor" """,
    }
