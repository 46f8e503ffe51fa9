"""SQL building blocks for the DuckDB oracle of each registered query.

The tokenizer and field split are written once here so every oracle uses
the same JVM ``String.split`` contract as the Spark side.
"""

from __future__ import annotations


def tok(x: str) -> str:
    """DuckDB: ``x.split(" ")``."""
    return (f"(CASE WHEN ({x}) = '' THEN [''] WHEN rtrim({x}, ' ') = '' THEN []::VARCHAR[] "
            f"ELSE string_split(rtrim({x}, ' '), ' ') END)")


def fields(x: str) -> str:
    """DuckDB: ``x.split("\\u001f")`` (trailing empty fields dropped)."""
    stripped = f"regexp_replace({x}, '[' || chr(31) || ']+$', '')"
    return (f"(CASE WHEN ({x}) = '' THEN [''] WHEN {stripped} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({stripped}, chr(31)) END)")


def r6(x: str) -> str:
    """Round a double to 6 digits. The 1e-9 shift moves exact decimal ties
    (common in rank sums) off the rounding boundary, so summation order
    cannot flip the last digit; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round(({x}) + 1e-9, 6) + 0.0)"


REVISIONS = """revisions AS (
  SELECT turn AS seq, conv_id AS page, text AS new_text,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_text
  FROM conversations)"""

GRAPH_C_LINES = """c_lines AS (
  SELECT o_custkey AS src, l_suppkey AS dst, o_orderdate, o_orderkey, l_linenumber, l_returnflag
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


GRAPH_C = "SELECT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
GRAPH_P = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
GRAPH_B = (f"SELECT t[i] AS src, t[i + 1] AS dst FROM (SELECT t, unnest(range(1, len(t))) AS i "
           f"FROM (SELECT {tok('replace(text, chr(10), chr(32))')} AS t FROM documents))")


def pagerank_ctes(edges_sql: str, iters: int, damping: float = 0.85, keep: str = "all",
                  tag: str = "") -> list[str]:
    """CTEs ``{tag}e, {tag}deg, {tag}ew, {tag}nodes, {tag}r0 .. {tag}r{iters}``;
    ``r{k}(node, r)`` is iteration k. ``keep='survivors'`` starts from the
    sources and inner-joins each iteration."""
    a, d = repr(1.0 - damping), repr(damping)
    p = tag
    ctes = [f"{p}e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges_sql}))",
            f"{p}deg AS MATERIALIZED (SELECT src, count(*) AS outdeg FROM {p}e GROUP BY src)",
            f"{p}ew AS MATERIALIZED (SELECT {p}e.src, {p}e.dst, 1.0::DOUBLE / {p}deg.outdeg AS w "
            f"FROM {p}e JOIN {p}deg ON {p}e.src = {p}deg.src)",
            f"{p}nodes AS MATERIALIZED (SELECT src AS node FROM {p}e UNION SELECT dst AS node FROM {p}e)"]
    start = f"SELECT src AS node FROM {p}deg" if keep == "survivors" else f"SELECT node FROM {p}nodes"
    ctes.append(f"{p}r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS r FROM ({start}))")
    for k in range(1, iters + 1):
        prev = f"{p}r{k - 1}"
        s = (f"(SELECT {p}ew.dst AS node, sum({prev}.r * {p}ew.w) AS s FROM {p}ew "
             f"JOIN {prev} ON {p}ew.src = {prev}.node GROUP BY {p}ew.dst)")
        if keep == "survivors":
            ctes.append(f"{p}r{k} AS MATERIALIZED (SELECT q.node, {a}::DOUBLE + {d}::DOUBLE * s.s AS r "
                        f"FROM {prev} q JOIN {s} s ON q.node = s.node)")
        else:
            ctes.append(f"{p}r{k} AS MATERIALIZED (SELECT n.node, {a}::DOUBLE + {d}::DOUBLE * coalesce(s.s, 0.0) AS r "
                        f"FROM {p}nodes n LEFT JOIN {s} s ON n.node = s.node)")
    return ctes


def pagerank_sql(edges_sql: str, iters: int = 5, damping: float = 0.85) -> str:
    ctes = pagerank_ctes(edges_sql, iters, damping, "all")
    return f"WITH {', '.join(ctes)} SELECT node, {r6('r')} AS rank FROM r{iters}"


def history_select(iters: int, tag: str = "", rounded: bool = True) -> str:
    """``node, i0 .. i{iters-1}`` from the CTEs of ``pagerank_ctes``."""
    rnd = r6 if rounded else (lambda x: x)
    cols = ", ".join(f"{rnd(f'{tag}r{k}.r')} AS i{k - 1}" for k in range(1, iters + 1))
    joins = " ".join(f"JOIN {tag}r{k} ON {tag}r{k}.node = {tag}r{iters}.node" for k in range(1, iters))
    return f"SELECT {tag}r{iters}.node AS node, {cols} FROM {tag}r{iters} {joins}"


def history_sql(edges_sql: str, iters: int = 5, damping: float = 0.85, keep: str = "all") -> str:
    ctes = pagerank_ctes(edges_sql, iters, damping, keep)
    return f"WITH {', '.join(ctes)} {history_select(iters)}"


CUTOFF_TS = "TIMESTAMP '2001-06-01'"

# Base graph and net change log of graph U (see plans.inputs).
CHANGELOG_CTES = [
    GRAPH_C_LINES,
    f"base AS (SELECT DISTINCT src, dst FROM c_lines WHERE o_orderdate < {CUTOFF_TS})",
    f"""net AS (SELECT src, dst, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS op FROM c_lines
       WHERE o_orderdate >= {CUTOFF_TS}
       QUALIFY row_number() OVER (PARTITION BY src, dst
                                  ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC, op DESC) = 1)""",
    """newe AS (SELECT b.src, b.dst FROM base b ANTI JOIN net n ON b.src = n.src AND b.dst = n.dst
       UNION ALL SELECT src, dst FROM net WHERE op = 1)""",
]


def delta_sql(iters: int = 5, damping: float = 0.85) -> str:
    """history(E') - history(E) over the nodes of both graphs (isolated = 1 - d)."""
    a = repr(1.0 - damping)
    ctes = (CHANGELOG_CTES + pagerank_ctes("SELECT * FROM base", iters, damping, "all", "o")
            + pagerank_ctes("SELECT * FROM newe", iters, damping, "all", "n")
            + [f"oh AS ({history_select(iters, 'o', rounded=False)})",
               f"nh AS ({history_select(iters, 'n', rounded=False)})"])
    cols = ", ".join(f"{r6(f'coalesce(nh.i{j}, {a}) - coalesce(oh.i{j}, {a})')} AS i{j}" for j in range(iters))
    return (f"WITH {', '.join(ctes)} SELECT coalesce(nh.node, oh.node) AS node, {cols} "
            f"FROM nh FULL OUTER JOIN oh ON nh.node = oh.node")


def new_history_sql(iters: int = 5, damping: float = 0.85) -> str:
    ctes = CHANGELOG_CTES + pagerank_ctes("SELECT * FROM newe", iters, damping, "all", "n")
    return f"WITH {', '.join(ctes)} {history_select(iters, 'n')}"
