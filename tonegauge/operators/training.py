"""Training and evaluation sets of a steering probe, end to end.

``create_train_test`` (F14) halves the probe, samples texts and draws per text on each side and adds
the prompts; a side with a saved table is read instead.  ``evaluation_set`` (F13) is the labelled
union of two splits, or of four with the cross-probes.  ``prepare`` (F15) clips the weights (E7) and
writes the three tables as one phase.

A phase of several tables is valid only if all of them are.  Every attempt writes into a folder of its own;
a manifest that names the tables, their row counts and the settings comes last.  A start with the same
settings that finds the manifest reads the tables it names; an attempt that died leaves no manifest and is
ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegauge.functions import text as tx
from tonegauge.keys import u
from tonegauge.operators import normalise as N
from tonegauge.operators import prompts as PR
from tonegauge.operators import splits as SP
from tonegauge.sources import tables as TB

CHAT = "array<struct<role:string,content:string>>"
#: order of a side's rows: by text, then by draw
ORDER = ["original_index", "draw"]


@dataclass(frozen=True)
class TrainingConfig:
    """Sizes, seeds and switches of a training set; paths name saved tables to use instead of sampling."""

    n_source_texts: int
    instructions_per_text: int
    num_train_prompts_for_eval: int
    num_test_prompts_for_eval: int
    insts_per_probe_source_text: int | None = 1
    prompt_strategy: str = "direct"
    chat: bool = True
    clip_min: float = 0.0
    clip_max: float = 10.0
    cross_probes: bool = True
    probe_seed: int = 42
    train_seed: int = 42
    test_seed: int = 43
    train_probe_path: str | None = None
    test_probe_path: str | None = None

    def check(self) -> None:
        """The divisibility that whole groups of draws need."""
        for name in ("num_train_prompts_for_eval", "num_test_prompts_for_eval"):
            for by in ("instructions_per_text", "insts_per_probe_source_text"):
                k = getattr(self, by)
                if k is not None and getattr(self, name) % k:
                    raise ValueError(f"{name} ({getattr(self, name)}) is no multiple of {by} ({k})")
        if self.insts_per_probe_source_text is None and self.test_probe_path is None:
            raise ValueError("a test side without insts_per_probe_source_text needs test_probe_path")


def drawn(half: DataFrame, n_texts: int, per_text: int, seed: int) -> DataFrame:
    """F9 and F10 with the order kept: ``draw`` (from 1) numbers the rows taken of each text."""
    w = Window.partitionBy("original_index").orderBy("_u", "rep")
    rows = SP.sample_sources(half, n_texts, seed=seed).withColumn("_u", u("col:original_index", "col:rep", seed, "pergroup"))
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= per_text).drop("_u")


def read_saved(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A saved side: chat prompts stored as JSON text are parsed again."""
    df = TB.read_table(spark, path, schema)
    if df.schema["prompt"].dataType == T.StringType():
        chat = F.from_json("prompt", CHAT)
        df = df.withColumn("prompt", chat) if df.filter(F.col("prompt").isNotNull() & chat.isNull()).isEmpty() else df
    return df


def create_train_test(probe: DataFrame, goals: list[str], cfg: TrainingConfig, model_name: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) with filled targets, instructions, prompt and ``model_name``."""
    halves = SP.split_fraction(probe, ["original_index", "rep"], 0.5, cfg.probe_seed)

    def side(first: bool, n_texts: int, per_text: int, seed: int) -> DataFrame:
        half = halves.filter("in_first" if first else "not in_first").drop("in_first")
        return PR.prompt_columns(drawn(half, n_texts, per_text, seed), goals, ["original_index", "rep"], model_name, cfg.prompt_strategy, chat=cfg.chat)

    spark = probe.sparkSession
    train = (read_saved(spark, cfg.train_probe_path) if cfg.train_probe_path
             else side(True, cfg.n_source_texts, cfg.instructions_per_text, cfg.train_seed))
    if cfg.test_probe_path:
        return train, read_saved(spark, cfg.test_probe_path)
    k = cfg.insts_per_probe_source_text
    return train, side(False, cfg.num_test_prompts_for_eval // k, k, cfg.test_seed)


def evaluation_set(train: DataFrame, test: DataFrame, goals: list[str], cfg: TrainingConfig) -> DataFrame:
    """the first texts of ``train`` and all of ``test``, and with ``cross_probes`` each side's texts under the
    other side's deltas, instructions and prompts; ``split`` names the part.

    The pairing is one join of positions, used in both directions; what the longer side has more is not crossed.
    """
    k = cfg.insts_per_probe_source_text
    if k is None:
        some = train.orderBy(*ORDER).limit(cfg.num_train_prompts_for_eval)
    else:
        some = SP.first_groups(train, k, cfg.num_train_prompts_for_eval // k, "original_index", ORDER)
    if not cfg.cross_probes:
        return SP.label_union([("train", some), ("test", test)])
    pairs = SP.paired_keys(some, test, ORDER)
    copied = ("instructions", "prompt")
    return SP.label_union([
        ("train", some), ("train_source_test_inst", SP.crossed(some, test, pairs, goals, ORDER, copied, "a", "b")),
        ("test_source_train_inst", SP.crossed(test, some, pairs, goals, ORDER, copied, "b", "a")), ("test", test)])


def cross_faults(evaluation: DataFrame, goals: list[str]) -> DataFrame:
    """(check, faults) of the four equalities of cross-probes: each keeps its source's texts and takes its
    partner's deltas, instructions and prompts, position by position; 0 faults is right.

    Positions are those inside each split; the parts of the longer side beyond the pairs have no partner.
    """
    from tonegauge.operators.ordered import positions
    facts = {"source": ["original_index", "text", *[f"source_{g}" for g in goals]], "inst": ["instructions", "prompt", *[f"delta_{g}" for g in goals]]}
    base = evaluation.select("split", *ORDER, *[F.xxhash64(*cols).alias(name) for name, cols in facts.items()])
    placed = {s: positions(base.filter(F.col("split") == s).select(*ORDER, *facts), ORDER)
              for s in ("train", "train_source_test_inst", "test_source_train_inst", "test")}
    out = None
    for cross, of, fact in (("test_source_train_inst", "test", "source"), ("train_source_test_inst", "train", "source"),
                            ("train_source_test_inst", "test", "inst"), ("test_source_train_inst", "train", "inst")):
        a, b = placed[cross].select("pos", F.col(fact).alias("x")), placed[of].select("pos", F.col(fact).alias("y"))
        row = a.join(b, "pos", "left").agg(F.lit(f"{fact} of {cross} = {of}").alias("check"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("faults"))
        out = row if out is None else out.unionByName(row)
    return out


def _manifest(spark: SparkSession, folder: str, settings: str) -> dict | None:
    path = f"{folder}/manifest"
    if not TB.written(spark, path):
        return None
    for row in spark.read.schema("settings string, tables string").json(path).collect():  # one row an attempt
        if row.settings == settings:
            return json.loads(row.tables)
    return None


def written_together(spark: SparkSession, folder: str, settings: dict, build, fmt: str = "parquet", redo: bool = False) -> dict[str, DataFrame]:
    """The tables that ``build()`` names, written as one phase, or those of an earlier start with equal ``settings``.

    CSV keeps nested columns as JSON text.  The manifest appends, so starts with other settings keep theirs.
    """
    wanted = json.dumps(settings, sort_keys=True)
    known = None if redo else _manifest(spark, folder, wanted)
    if known is None:
        attempt, known = f"{folder}/{uuid.uuid4().hex}", {}
        for name, df in build().items():
            path, schema = f"{attempt}/{name}.{fmt}", df.schema.json()
            flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields]
            TB.write_table(df.select(*flat) if fmt == "csv" else df, path, fmt)
            known[name] = {"path": path, "schema": schema}
        spark.createDataFrame([(wanted, json.dumps(known))], "settings string, tables string").write.mode("overwrite" if redo else "append").json(f"{folder}/manifest")
    return {name: _read_back(spark, x["path"], T.StructType.fromJson(json.loads(x["schema"]))) for name, x in known.items()}


def _read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not path.endswith(".csv"):
        return spark.read.schema(schema).parquet(path)
    nested = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema.fields])
    df = TB.read_table(spark, path, flat)
    return df.withColumns({c: F.from_json(c, t.simpleString()) for c, t in nested.items()})


def prepare(probe: DataFrame, goals: list[str], cfg: TrainingConfig, model_name: str, folder: str, run: str, fmt: str = "parquet",
            redo: bool = False) -> dict[str, DataFrame]:
    """``{"train", "test", "eval"}`` of a run, written below ``folder/run`` and read back.

    ``train`` has its weights clipped to the configured range (E7), and so has what ``eval`` takes from it."""
    cfg.check()

    def build() -> dict[str, DataFrame]:
        from tonegauge.store import written_once
        train, test = (written_once(df, "side") for df in create_train_test(probe, goals, cfg, model_name))
        train, _ = N.clip_weights(train, cfg.clip_min, cfg.clip_max)
        return {"train": train, "test": test, "eval": evaluation_set(train, test, goals, cfg)}

    return written_together(probe.sparkSession, f"{folder}/{run}", asdict(cfg) | {"model": model_name, "goals": goals}, build, fmt, redo)
