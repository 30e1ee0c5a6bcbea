"""Tables that change together: versioned folders, and a pointer that is written last.

A version is a small JSON file under `_versions/`, named by its number, that says which folders make up each table. Data
is written to new folders first; then the version's file is renamed into place, which fails if that number is there
already. A reader takes the highest number, so it sees all tables of a commit or none, and there is no moment without a
version. Folders that no version names are leftovers of writers that stopped; `purge` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first."""


class Tables:
    """A root folder of versioned tables. `after` is called with the name of each step when it is done."""

    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] = lambda step: None):
        self.spark, self.root, self.after = spark, root.rstrip("/"), after
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """The newest version, or the one of this number: number, tables (folders and files left out of them), ledger."""
        known = self._numbers()
        if not known or number is not None and number not in known:
            return {"number": 0, "tables": {}, "ledger": {}}
        path = f"{self.root}/_versions/{number or known[-1]:012d}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))

    def names(self) -> list[str]:
        return sorted(self.version()["tables"])

    def _read(self, state: dict, name: str) -> DataFrame:
        entry = state["tables"][name]
        df = self.spark.read.schema(entry["schema"]).parquet(*(f"{self.root}/{f}" for f in entry["folders"]))
        return df.filter(~F.col("_metadata.file_name").isin(entry["without"])) if entry["without"] else df

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table of the newest version, or of an older one."""
        return self._read(self.version(number), name)

    def _written(self, df: DataFrame, name: str) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self.after(f"wrote {name}")
        return folder

    def _publish(self, state: dict) -> int:
        state["number"] += 1
        target = f"{self.root}/_versions/{state['number']:012d}.json"
        staged = f"{self.root}/_versions/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(staged), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.after("staged the version")
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(staged), self._path(target)):
            self._fs.delete(self._path(staged), False)
            raise Conflict(f"version {state['number']} is there already")
        self.after("published")
        return state["number"]

    def commit(self, put: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, ledger: dict[str, int] | None = None) -> int:
        """Replaces the tables of `put` and adds to those of `append`, all in one version; its number. Columns stay as they were first."""
        state = self.version()
        for name, df in (put or {}).items():
            state["tables"][name] = {"schema": df.schema.toDDL(), "folders": [self._written(df, name)], "without": []}
        for name, df in (append or {}).items():
            entry = state["tables"].setdefault(name, {"schema": df.schema.toDDL(), "folders": [], "without": []})
            entry["folders"].append(self._written(df, name))
        state["ledger"] |= ledger or {}
        return self._publish(state)

    def erase(self, column: str, subject, actor: str, tables: list[str] | None = None) -> int:
        """Removes a subject's rows from every table that has the column (or those named), in one version with an audit row.

        Copy on write: the files that hold the subject are found by the files' own paths, and only they are written
        anew, without it. The version leaves them out; `purge` removes them for good.
        """
        state = self.version()
        for name in tables or [n for n in state["tables"] if n != "audit"]:
            df = self._read(state, name)
            if column not in df.columns:
                continue
            touched = [r[0] for r in df.filter(F.col(column) == F.lit(subject)).select("_metadata.file_name").distinct().collect()]
            if not touched:
                continue
            rest = df.filter(F.col("_metadata.file_name").isin(touched)).filter(~F.col(column).eqNullSafe(F.lit(subject)))
            entry = state["tables"][name]
            entry["folders"].append(self._written(rest, name))
            entry["without"] += touched
        entry = state["tables"].setdefault("audit", {"schema": "action STRING,actor STRING,subject STRING,at TIMESTAMP", "folders": [], "without": []})
        row = self.spark.range(1).select(F.lit("erase").alias("action"), F.lit(actor).alias("actor"), F.sha2(F.lit(str(subject)), 256).alias("subject"), F.current_timestamp().alias("at"))
        entry["folders"].append(self._written(row, "audit"))
        return self._publish(state)

    def export(self, column: str, subject) -> DataFrame:
        """(table, row): the subject's rows of every table that has the column, as JSON."""
        state, out = self.version(), None
        for name in sorted(state["tables"]):
            df = self._read(state, name)
            if column in df.columns:
                own = df.filter(F.col(column) == F.lit(subject)).select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
                out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], "table string, row string")

    def purge(self) -> list[str]:
        """Removes all but the newest version: older ones, folders that it doesn't name, files that it leaves out. Not while others write."""
        state, gone = self.version(), []
        folders = {f for e in state["tables"].values() for f in e["folders"]}

        def drop(path) -> None:
            self._fs.delete(path, True)
            gone.append(path.toString())

        for number in self._numbers()[:-1]:
            drop(self._path(f"{self.root}/_versions/{number:012d}.json"))
        for top in self._fs.listStatus(self._path(self.root)):
            name = top.getPath().getName()
            if name.startswith("_"):
                continue
            left_out = set(state["tables"].get(name, {}).get("without", []))
            for part in self._fs.listStatus(top.getPath()):
                if f"{name}/{part.getPath().getName()}" not in folders:
                    drop(part.getPath())
                    continue
                for file in self._fs.listStatus(part.getPath()) if left_out else []:
                    if file.getPath().getName() in left_out:
                        drop(file.getPath())
        return gone


def response_tables(responses: DataFrame, key: str = "recommendation_id") -> dict[str, DataFrame]:
    """Nested responses as five tables: sessions, items, packs, pack_items and impressions, one row a pack that was shown.

    responses: key, user_id, conditions, recommendations (array of struct component_id, name, reason, score, type,
    condition) and packs_ranked (array of struct pack_id, rank, score_final, components (array of struct component_id, name)
    and selected_products (array of struct component_id, product_id, price, availability)). Ranks count from 1; a pack
    without a name is called after its rank; of several products for a component the last one counts.
    """
    clean = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    items = responses.select(key, F.posexplode("recommendations").alias("_at", "_r"))
    items = items.select(key, (F.col("_at") + 1).alias("rank"), *[clean(F.col("_r")[c]).alias(n) for c, n in (("component_id", "component_id"), ("name", "component_name"), ("reason", "reason"), ("type", "recommendation_type"), ("condition", "condition_code"))], F.col("_r.score").cast("double").alias("score_model"))
    rank = F.coalesce(F.col("_p.rank"), F.lit(0)).cast("int")
    packs = responses.select(key, "user_id", "conditions", F.explode("packs_ranked").alias("_p"))
    packs = packs.withColumn("rank", rank).withColumn("pack_key", F.coalesce(clean(F.col("_p.pack_id")), F.concat(F.lit("pack_"), rank.cast("string"))))
    parts = packs.select(key, "pack_key", F.col("_p.selected_products").alias("_s"), F.posexplode("_p.components").alias("_at", "_c")).filter("_c IS NOT NULL").withColumn("component_id", clean(F.col("_c.component_id")))
    product = F.get(F.reverse(F.filter("_s", lambda s: clean(s["component_id"]) == F.col("component_id"))), F.lit(0))
    parts = parts.withColumn("_product", product).select(key, "pack_key", (F.col("_at") + 1).alias("rank"), "component_id", clean(F.col("_c.name")).alias("component_name"), F.col("_product.product_id").alias("product_id"), F.col("_product.price").cast("double").alias("price_at_recommendation"), clean(F.col("_product.availability")).alias("availability_at_recommendation"))
    return {
        "sessions": responses.select(key, "user_id", F.to_json("conditions").alias("conditions")),
        "items": items,
        "packs": packs.select(key, "pack_key", "rank", F.col("_p.score_final").cast("double").alias("score_final")),
        "pack_items": parts,
        "impressions": packs.select(key, "user_id", "pack_key", F.col("rank").alias("position"), F.to_json("conditions").alias("conditions"), F.lit("impression").alias("event_type")),
    }
