"""Running a workflow: a function that gets a context, or uses ``tessera.frontend``, and returns or collects the relations to put out."""

from __future__ import annotations

import csv
import inspect
import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera import frontend, policy
from tessera.relation import Relation
from tessera.schema import ColumnSpec
from tessera.sources import tables


@dataclass
class Config:
    name: str = "workflow"
    pid: int = 1
    all_pids: list[int] = field(default_factory=lambda: [1, 2, 3])
    use_leaky_ops: bool = False
    use_floats: bool = False
    input_path: str = "."
    output_path: str = "./out"
    delimiter: str = ","
    header: bool = True
    malformed: str = "FAILFAST"
    output_kind: str = "csv"
    master_url: str | None = None
    spark: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_dict(conf: dict) -> "Config":
        """From the sections ``user_config`` (pid, all_pids, workflow_name, leaky_ops, use_floats, paths, ...) and
        ``backends.spark`` (available, master_url, conf). Other backends and network addresses have no meaning here."""
        user = conf["user_config"]
        paths, spark = user.get("paths", {}), conf.get("backends", {}).get("spark", {})
        out = Config(user["workflow_name"], int(user["pid"]), list(user["all_pids"]), bool(user.get("leaky_ops", 0)), bool(user.get("use_floats", 0)))
        out.input_path = paths.get("input_path", out.input_path)
        out.output_path = paths.get("output_path", f"{out.input_path}/out")
        for k in ("delimiter", "header", "malformed", "output_kind"):
            if k in user:
                setattr(out, k, user[k])
        if spark.get("available"):
            out.master_url, out.spark = spark.get("master_url"), dict(spark.get("conf", {}))
        return out

    @staticmethod
    def from_file(path: str) -> "Config":
        return Config.from_dict(json.loads(Path(path).read_text()))

    def session(self) -> SparkSession:
        b = SparkSession.builder.appName(self.name)
        if self.master_url:
            b = b.master(self.master_url)
        for k, v in self.spark.items():
            b = b.config(k, v)
        return b.getOrCreate()


@dataclass
class Context:
    """What a workflow function sees."""

    spark: SparkSession
    conf: Config
    outputs: list[Relation] = field(default_factory=list)

    def create(self, name: str, columns: Sequence[ColumnSpec], owners: Iterable[int], df: DataFrame | None = None) -> Relation:
        """An input relation: the rows given, or those of ``<input_path>/<name>.csv``."""
        c = self.conf
        rows = df if df is not None else tables.read_csv(self.spark, f"{c.input_path}/{name}.csv", columns, header=c.header, delimiter=c.delimiter, malformed=c.malformed)
        return Relation.create(rows, name, columns, owners)


@dataclass
class Result:
    outputs: list[Relation]
    paths: dict[str, str]
    seconds: float

    def report(self, all_parties: Iterable[int], expand: bool = False, rewrite: bool = False) -> str:
        from tessera.explain import describe

        return describe(self.outputs, all_parties, expand, rewrite)


def run_workflow(protocol: Callable[[Context], Relation | Sequence[Relation]], conf: Config | dict, spark: SparkSession | None = None, timings: str | None = None) -> Result:
    """Build the plan, then write each output to ``<output_path>/<name>``. An error ends the run and is raised.

    ``timings``: a CSV file to which name, seconds and a readable time are appended.
    """
    conf = Config.from_dict(conf) if isinstance(conf, dict) else conf
    spark = spark or conf.session()
    began = time.perf_counter()
    outputs = _build(protocol, conf, spark)
    paths = {}
    for r in outputs:
        paths[r.name] = f"{conf.output_path}/{r.name}"
        tables.store(r.df, paths[r.name], conf.output_kind, **({"delimiter": conf.delimiter} if conf.output_kind == "csv" else {}))
    seconds = time.perf_counter() - began
    if timings:
        with open(timings, "a", newline="") as f:
            csv.writer(f).writerow([conf.name, f"{seconds:.3f}", time.strftime("%H:%M:%S", time.gmtime(seconds))])
    return Result(outputs, paths, seconds)


def compile_only(protocol: Callable[[Context], Relation | Sequence[Relation]], conf: Config, spark: SparkSession) -> list[policy.Step]:
    """Where each step would run, without running any."""
    return policy.placement([r.node for r in _build(protocol, conf, spark)], conf.all_pids, conf.use_leaky_ops)


def _build(protocol: Callable, conf: Config, spark: SparkSession) -> list[Relation]:
    """The outputs: those that the protocol collected, else what it returned."""
    with frontend.using(Context(spark, conf)) as ctx:
        made = protocol(ctx) if inspect.signature(protocol).parameters else protocol()
    if ctx.outputs:
        return ctx.outputs
    if made is None:
        raise ValueError("the workflow neither collects nor returns a relation")
    return [made] if isinstance(made, Relation) else list(made)
