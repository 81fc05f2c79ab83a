"""Default target from loan status, and its guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import strip
from ..schema import BAD_STATUSES, GOOD_STATUSES, TARGET, UNRESOLVED_STATUSES

RESOLVED_STATUSES = GOOD_STATUSES + BAD_STATUSES
KNOWN_STATUSES = RESOLVED_STATUSES + UNRESOLVED_STATUSES


#: Unknown values that an error names; a wrong column may hold one for every row.
NAMED_STATUSES = 50


def status_text(column: str = "loan_status") -> Column:
    return strip(F.coalesce(F.col(column).cast("string"), F.lit("")))


def unknown_statuses(df: DataFrame) -> DataFrame:
    """Status values outside the domain, with their row counts."""
    return (
        df.select(status_text().alias("loan_status"))
        .filter(~F.col("loan_status").isin(*KNOWN_STATUSES))
        .groupBy("loan_status")
        .agg(F.count("*").alias("rows"))
    )


def construct_target(df: DataFrame, unknown: str = "list") -> DataFrame:
    """Keep resolved loans and add the 0/1 target.

    An unknown status is always an error. ``unknown="list"`` looks for them first, in one pass over
    the status column, and names the first ``NAMED_STATUSES``. ``unknown="fail_fast"`` puts the check into the row filter
    itself, so that large tables are read only once; the failing job then names the first one met.
    """
    if "loan_status" not in df.columns:
        raise ValueError("accepted loan data must include loan_status")
    status = status_text()
    resolved = status.isin(*RESOLVED_STATUSES)
    if unknown == "list":
        found = sorted(row[0] for row in unknown_statuses(df).orderBy("loan_status").limit(NAMED_STATUSES + 1).select("loan_status").collect())
        if found:
            more = " and more; unknown_statuses() lists all" if len(found) > NAMED_STATUSES else ""
            raise ValueError(f"unknown loan_status values: {found[:NAMED_STATUSES]}{more}")
        keep = resolved
    elif unknown == "fail_fast":
        keep = (
            F.when(resolved, True)
            .when(status.isin(*UNRESOLVED_STATUSES), False)
            .otherwise(F.raise_error(F.concat(F.lit("unknown loan_status value: "), status)).cast("boolean"))
        )
    else:
        raise ValueError(f"unknown mode for unknown statuses: {unknown}")
    return df.filter(keep).withColumn(TARGET, status.isin(*BAD_STATUSES).cast("int"))


def target_summary(df: DataFrame) -> DataFrame:
    """Included, excluded and total rows with the three status domains, as one row."""
    resolved = status_text().isin(*RESOLVED_STATUSES)
    domains = {
        "good_statuses": GOOD_STATUSES,
        "bad_statuses": BAD_STATUSES,
        "dropped_statuses": UNRESOLVED_STATUSES,
    }
    return df.agg(
        F.count_if(resolved).alias("included_rows"),
        F.count_if(~resolved).alias("excluded_rows"),
        F.count("*").alias("total_rows"),
    ).select(
        F.lit(TARGET).alias("target"),
        *[F.array(*[F.lit(v) for v in sorted(values)]).alias(name) for name, values in domains.items()],
        "included_rows", "excluded_rows", "total_rows",
    )


def drop_unlabelled(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.na.drop(subset=[target])
