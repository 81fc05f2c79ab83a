"""Building blocks of the comparison SQL (DuckDB)."""

from __future__ import annotations

from creditloom.schema import BAD_STATUSES, GOOD_STATUSES, NUMERIC_FEATURES, SPLIT_RATIOS
from creditloom.sources.testtables import LOANS_SQL


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


RESOLVED = quoted(GOOD_STATUSES + BAD_STATUSES)
BAD = quoted(BAD_STATUSES)

LOANS = f"loans as ({LOANS_SQL})"


def _log(c: str) -> str:
    return f"case when {c} is not null then ln(1 + greatest({c}, 0)) end as {c}"


def _percent(c: str) -> str:
    return f"try_cast(replace(trim({c}), '%', '') as double) as {c}"


_FEATURES_SQL = {
    "loan_amnt": _log("loan_amnt"), "annual_inc": _log("annual_inc"), "revol_bal": _log("revol_bal"),
    "total_acc": _log("total_acc"), "int_rate": _percent("int_rate"), "revol_util": _percent("revol_util"),
    "dti": "case when dti is not null then least(greatest(dti, 0), 100) end as dti",
}
NUMBERS = ", ".join(_FEATURES_SQL.get(c, c) for c in NUMERIC_FEATURES)
CATEGORIES = (
    "grade, sub_grade, emp_length, home_ownership, verification_status, purpose, addr_state, application_type, "
    "initial_list_status"
)
PREPARED = f"""{LOANS},
prepared as (
  select id, p_raw, {CATEGORIES}, {NUMBERS},
    case when trim(loan_status) in ({BAD}) then 1 else 0 end as y,
    cast(regexp_extract(term, '(\\d+)', 1) as int) as term_months,
    cast(try_strptime(issue_d, '%b-%Y') as date) as issue_dt
  from loans where trim(coalesce(loan_status, '')) in ({RESOLVED})
)"""

_SHARES = [sum(SPLIT_RATIOS[: i + 1]) for i in range(3)]
_REACHED = " + ".join(f"cast(before_n >= floor(total_n * {s!r}::double) as int)" for s in _SHARES)
SPLIT = f"""{PREPARED},
dates as (select issue_dt as d, count(*) as n from prepared group by 1),
placed as (
  select d, n, coalesce(sum(n) over (order by d rows between unbounded preceding and 1 preceding), 0) as before_n,
    sum(n) over () as total_n from dates
),
split_of as (select d, case {_REACHED} when 0 then 'train' when 1 then 'calibration' when 2 then 'validation' else 'test' end as split from placed),
loans_split as (select p.*, s.split from prepared p join split_of s on p.issue_dt = s.d)"""


def score_ctes(source: str, by: str = "") -> str:
    """CTEs ``g`` (distinct scores) and ``c`` (with running counts from the top) of rows (by, p, y)."""
    lead = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f"""g as (select {lead}p, count(*) as n, cast(sum(y) as bigint) as pos from ({source}) where p is not null and y is not null group by {lead}p),
c as (select *, n - pos as neg,
  sum(pos) over ({part}order by p desc rows unbounded preceding) as caught,
  sum(n) over ({part}order by p desc rows unbounded preceding) as flagged,
  sum(pos) over ({part.strip()}) as all_pos, sum(n) over ({part.strip()}) as all_n from g)"""


def metrics_select(by: str = "") -> str:
    """One metric row (per group) from the CTE ``c``."""
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    both = "max(all_pos) > 0 and max(all_pos) < max(all_n)"
    return f"""select {lead}cast(sum(n) as bigint) as rows,
  round(case when {both} then sum(neg::double * ((caught - pos)::double + pos / 2.0::double)) / (max(all_pos)::double * (max(all_n) - max(all_pos))::double) end, 6) as roc_auc,
  round(case when {both} then sum(pos::double * (caught::double / flagged::double)) / max(all_pos)::double end, 6) as pr_auc,
  round(sum(pos * power(1 - p, 2) + neg * power(p, 2)) / sum(n)::double, 6) as brier_score,
  round(case when {both} then sum(-(pos * ln(least(greatest(p, 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double))
    + neg * ln(least(greatest(1 - p, 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double)))) / sum(n)::double end, 6) as log_loss,
  round(sum(p * n) / sum(n)::double, 6) as mean_predicted_default,
  round(sum(pos)::double / sum(n)::double, 6) as actual_default_rate
  from c {group}"""


def edge_list(column: str, bins: int, digits: int | None = 12) -> str:
    probabilities = ", ".join(repr(i * (1.0 / bins)) + "::double" for i in range(bins)) + ", 1.0::double"
    edge = "e" if digits is None else f"round(e, {digits})"
    return f"list_sort(list_distinct(list_transform(quantile_cont({column}, [{probabilities}]), lambda e: {edge})))"


def bin_of(value: str, edges: str) -> str:
    return f"greatest(1, len(list_filter({edges}[1:len({edges}) - 1], lambda e: e < {value})))"


def newton_ctes(steps: int = 9) -> str:
    """CTE ``fitted(b)``: coefficients of the penalised logistic fit of ``rows_fit`` (y, w, x; x ends with 1), by Newton steps.

    Only entries of x that are not zero enter the second moments; each step's system is solved by elimination without pivoting,
    as its matrix is positive definite.
    """
    ctes = ["""fit_rows as materialized (select row_number() over () as r, y::double as y, w::double as w, x from rows_fit),
width as materialized (select max(len(x)) as d from fit_rows),
entries as materialized (select r, i, v from (select r, unnest(range(1, len(x) + 1)) as i, unnest(x) as v from fit_rows) where v <> 0),
products as materialized (select a.r, a.i, b.i as j, a.v * b.v as v from entries a join entries b on a.r = b.r),
grid as materialized (select i, j from (select unnest(range(1, d + 1)) as i from width), (select unnest(range(1, d + 1)) as j from width)),
b0 as (select list_transform(range(0, d), lambda i: 0.0::double) as b from width)"""]
    for k in range(1, steps + 1):
        ctes.append(f"""at{k} as materialized (select r, y, w, 1 / (1 + exp(-list_dot_product(x, b))) as p from fit_rows, b{k - 1}),
g{k} as (select i, sum(w * (y - p) * v) as g from entries join at{k} using (r) group by i),
h{k} as (select i, j, sum(w * p * (1 - p) * v) as h from products join at{k} using (r) group by i, j),
m{k} as (
  select list(line order by i) as m from (
    select i, list(coalesce(h, 0) + case when i = j then 1.0::double else 0.0::double end order by j) || [any_value(coalesce(g, 0) - b[i])] as line
    from grid left join h{k} using (i, j) left join g{k} using (i), b{k - 1} group by i
  )
),
b{k} as materialized (
  select list_transform(range(1, d + 1), lambda i: b[i] + solved[i][d + 1]) as b from b{k - 1}, width, (
    select list_reduce(range(1, len(m) + 1), lambda a, k: list_transform(a, lambda line, r: case when r = k
      then list_transform(line, lambda v: v / line[k]) else list_transform(line, lambda v, c: v - line[k] * a[k][c] / a[k][k]) end), m) as solved from m{k}
  )
)""")
    ctes.append(f"fitted as materialized (select b from b{steps})")
    return ",\n".join(ctes)
