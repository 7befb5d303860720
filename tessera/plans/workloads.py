"""The workflows that the engine is for, over party relations; each takes relations and returns one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.relation import Relation, concat
from tessera.schema import col_spec


def parties(df: DataFrame, key: str, n: int, name: str, columns: Sequence[str]) -> list[Relation]:
    """A table dealt to n parties by its key modulo n: relation i has party i's rows, seen by it alone."""
    return [
        Relation.create(df.where(F.col(key) % n == i).select(*columns), f"{name}{i + 1}", [col_spec(c, "INTEGER", i + 1) for c in columns], {i + 1})
        for i in range(n)
    ]


def concentration(inputs: Sequence[Relation], company: str = "companyID", price: str = "price") -> Relation:
    """Market concentration: the sum over companies of the square of their share of revenue in percent, all divisions truncated."""
    together = concat(inputs, "cab_data", [company, price])
    revenue = together.aggregate("revenue", [company], price, "sum", "local_rev").divide("scaled_down", "local_rev", ["local_rev", 1000])
    zeroed = revenue.multiply("zeroed", company, [company, 0])
    scaled = zeroed.multiply("scaled_up", "local_rev", ["local_rev", 100])
    total = zeroed.aggregate("total", [company], "local_rev", "sum", "global_rev")
    shares = scaled.join(total, "with_total", [company], [company]).divide("shares", "m_share", ["local_rev", "global_rev"])
    squares = shares.multiply("squares", "m_share", ["m_share", "m_share", 1])
    return squares.aggregate("hhi", [company], "m_share", "sum", "hhi")


def cohort(medications: Sequence[Relation], diagnoses: Sequence[Relation], patient: tuple[str, str], drug: str, drug_day: str, code: str, code_day: str) -> Relation:
    """Patients who took the drug (1) after the diagnosis (1): their number. Each side is held by one party or more."""
    meds = medications[0] if len(medications) == 1 else concat(medications, "medication")
    diags = diagnoses[0] if len(diagnoses) == 1 else concat(diagnoses, "diagnosis")
    joined = meds.join(diags, "joined", [patient[0]], [patient[1]])
    cases = joined.filter("cases", code_day, "<", other=drug_day)
    return cases.filter("took", drug, "==", scalar=1).filter("ill", code, "==", scalar=1).distinct_count("patients", patient[0])


def shared_cohort(medications: Sequence[Relation], diagnoses: Sequence[Relation], patient: tuple[str, str], drug: str, drug_day: str, code: str, code_day: str) -> tuple[Relation, list[Relation]]:
    """The cohort split by whether both parties know a patient: the joint count over shared patients, and each party's own over the rest."""
    known = [m.union(d, f"pids{i}", *patient) for i, (m, d) in enumerate(zip(medications, diagnoses))]
    shared = known[0].pub_intersect("shared_pids", patient[0], known[1]).persist("shared_pids")
    m_in = [m.project(f"m{i}", [patient[0], drug, drug_day]).filter_by(f"m{i}_shared", patient[0], shared) for i, m in enumerate(medications)]
    d_in = [d.project(f"d{i}", [patient[1], code, code_day]).filter_by(f"d{i}_shared", patient[1], shared) for i, d in enumerate(diagnoses)]
    own = []
    for i, (m, d) in enumerate(zip(medications, diagnoses)):
        m_out, d_out = m.filter_by(f"m{i}_own", patient[0], shared, negate=True), d.filter_by(f"d{i}_own", patient[1], shared, negate=True)
        own.append(cohort([m_out], [d_out], patient, drug, drug_day, code, code_day))
    return cohort(m_in, d_in, patient, drug, drug_day, code, code_day), own


def comorbidity(inputs: Sequence[Relation], code: str) -> Relation:
    """How often each diagnosis occurs over all parties, ascending."""
    return concat(inputs, "diagnoses").project("codes", [code]).aggregate_count("counts", [code], "total").sort_by("sorted", "total")


def credit_score(register: Relation, scores: Sequence[Relation], person: tuple[str, str], area: str, score: str) -> Relation:
    """The sum of the scores that companies hold, by the area that the register has for a person."""
    return register.join(concat(scores, "scores"), "joined", [person[0]], [person[1]]).aggregate("by_area", [area], score, "sum", "total")


def location_counts(inputs: Sequence[Relation], location: str = "location") -> Relation:
    return concat(inputs, "together").aggregate_count("heatmap", [location], f"by_{location}")


def market_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of lineitem's revenue over suppliers, dealt to three parties."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_suppkey").alias("companyID"), F.col("l_extendedprice").cast("long").alias("price"))
    return concentration(parties(rows, "l_orderkey", 3, "in", ["companyID", "price"])).df
