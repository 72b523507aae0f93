"""Common table expressions that the SQL of the catalogue starts with."""

CONTRACTS = """
contracts AS (
    SELECT o_custkey AS cf, o_orderkey AS id, CAST(o_orderdate AS DATE) AS inizio,
        CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 90 AS INTEGER) AS fine,
        o_orderpriority AS contract_type, o_totalprice AS retribuzione, CAST(o_orderkey % 4 AS INTEGER) AS prior
    FROM orders
)"""

SWEPT = (
    CONTRACTS
    + """,
steps AS (
    SELECT cf, inizio AS d, 1 AS step FROM contracts UNION ALL SELECT cf, fine + 1, -1 FROM contracts
),
days AS (SELECT cf, d AS inizio, sum(step) AS step FROM steps GROUP BY cf, d),
counted AS (
    SELECT cf, inizio, CAST(sum(step) OVER (PARTITION BY cf ORDER BY inizio ROWS UNBOUNDED PRECEDING) AS INTEGER) AS arco,
        lead(inizio) OVER (PARTITION BY cf ORDER BY inizio) - 1 AS fine
    FROM days
),
opened AS (
    SELECT *, CASE WHEN arco > 0 AND coalesce(lag(arco) OVER (PARTITION BY cf ORDER BY inizio), 0) = 0 THEN 1 ELSE 0 END AS o FROM counted
),
numbered AS (SELECT *, CAST(sum(o) OVER (PARTITION BY cf ORDER BY inizio ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM opened),
swept AS (
    SELECT cf, inizio, fine, arco, CASE WHEN arco > 0 THEN episode ELSE 0 END AS over_id, CAST(fine - inizio + 1 AS INTEGER) AS durata
    FROM numbered WHERE fine IS NOT NULL
)"""
)

SEGMENTS = (
    SWEPT
    + """,
segments AS (
    SELECT s.cf, coalesce(min(c.id), 0) AS id, s.inizio, s.fine, s.arco, s.over_id, s.durata, max(c.prior) AS prior,
        string_agg(c.contract_type, '->' ORDER BY c.inizio, c.id) AS ct, avg(c.retribuzione) AS retribuzione,
        CASE WHEN s.arco = 0 THEN 'disoccupato' WHEN s.arco = 1 THEN CASE WHEN max(c.prior) >= 1 THEN 'occ_ft' ELSE 'occ_pt' END
            WHEN min(c.prior) >= 1 THEN 'over_ft_ft' WHEN max(c.prior) >= 1 THEN 'over_pt_ft' ELSE 'over_pt_pt' END AS stato
    FROM swept s LEFT JOIN contracts c ON c.cf = s.cf AND c.inizio <= s.inizio AND c.fine >= s.fine
    GROUP BY s.cf, s.inizio, s.fine, s.arco, s.over_id, s.durata
)"""
)

PERIODS = SEGMENTS + """,
periods AS (SELECT *, CASE WHEN inizio < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period FROM segments)"""


def overlapping(source: str, name: str) -> str:
    """Rows of one employment episode as one row."""
    return f"""
{name} AS (
    SELECT cf, min(inizio) AS inizio, max(fine) AS fine, max(arco) AS arco, min(over_id) AS over_id, CAST(sum(durata) AS INTEGER) AS durata,
        max(prior) AS prior, avg(retribuzione) AS retribuzione, string_agg(ct, '->' ORDER BY inizio) AS ct, CAST(sum(n_periods) AS INTEGER) AS n_periods
    FROM (SELECT *, CASE WHEN over_id > 0 THEN over_id ELSE -1000000 - (inizio - DATE '1970-01-01') END AS island FROM {source})
    GROUP BY cf, island
)"""


def consecutive(source: str, name: str) -> str:
    """Adjoining rows of one status as one row."""
    return f"""
{name}_flags AS (
    SELECT *, CASE WHEN inizio = lag(fine) OVER w + 1 AND (arco > 0) = (lag(arco) OVER w > 0) THEN 0 ELSE 1 END AS f
    FROM {source} WINDOW w AS (PARTITION BY cf ORDER BY inizio, fine)
),
{name} AS (
    SELECT cf, min(inizio) AS inizio, max(fine) AS fine, max(arco) AS arco, min(over_id) AS over_id, CAST(sum(durata) AS INTEGER) AS durata,
        max(prior) AS prior, avg(retribuzione) AS retribuzione, string_agg(ct, '->' ORDER BY inizio) AS ct, CAST(sum(n_periods) AS INTEGER) AS n_periods
    FROM (SELECT *, sum(f) OVER (PARTITION BY cf ORDER BY inizio, fine ROWS UNBOUNDED PRECEDING) AS island FROM {name}_flags)
    GROUP BY cf, island
)"""


def chain(column: str, which: str) -> str:
    if which == "none":
        return column
    link = -1 if which == "last" else 1
    return f"CASE WHEN contains({column}, '->') THEN trim(list_extract(string_split({column}, '->'), {link})) ELSE {column} END"


def moves(source: str = "segments", which: str = "last") -> str:
    """Unemployment between two jobs of persons with more than two rows: the rows behind the edges."""
    return f"""
around AS (
    SELECT *, lag(arco) OVER w AS pa, lead(arco) OVER w AS na, lag(ct) OVER w AS fc, lead(ct) OVER w AS tc, lag(durata) OVER w AS fd, lead(durata) OVER w AS td,
        lag(retribuzione) OVER w AS fr, lead(retribuzione) OVER w AS tr, lag(stato) OVER w AS fs, lead(stato) OVER w AS ts, count(*) OVER (PARTITION BY cf) AS n
    FROM {source} WINDOW w AS (PARTITION BY cf ORDER BY inizio, fine)
),
moves AS (
    SELECT *, {chain("fc", which)} AS f, {chain("tc", which)} AS t FROM around
    WHERE n > 2 AND arco = 0 AND pa >= 1 AND na >= 1 AND durata >= 1 AND fc IS NOT NULL AND tc IS NOT NULL
),
edges AS (SELECT f AS "from", t AS "to", count(*) AS weight, avg(durata) AS transition_duration FROM moves GROUP BY f, t)"""


EDGES = SEGMENTS + "," + moves()

ONES = "ones AS (SELECT *, 1 AS n_periods FROM segments)"
