"""Saving and loading knowledge bases and graphs: one folder per key with a Parquet table each, and JSON files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = "quillmill"
KNOWLEDGE, GRAPH = "kb", "graph"
_REF = "struct<document_id:string,section_id:string,page_number:int,quote:string>"
ENTITY = f"struct<name:string,type:string,description:string,aliases:array<string>,sources:array<{_REF}>,id:string>"
FACT = f"struct<statement:string,subject:string,predicate:string,object:string,sources:array<{_REF}>,id:string>"
RELATION = f"struct<source:string,target:string,type:string,description:string,source_id:string,target_id:string,sources:array<{_REF}>,id:string>"
DOCUMENT = "struct<id:string,title:string,source:string>"
KB_SCHEMA = f"entities array<{ENTITY}>, concepts array<{ENTITY}>, facts array<{FACT}>, relations array<{RELATION}>, documents array<{DOCUMENT}>"
GRAPH_SCHEMA = "nodes array<struct<id:string,kind:string,title:string,aliases:array<string>>>, edges array<struct<source:string,target:string,type:string,kind:string>>"


class StoreError(RuntimeError):
    """A key is missing or its content cannot be read."""


class TableStore:
    """Tables under base/namespace/kind/key/name; any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str, namespace: str = NAMESPACE):
        self.spark, self.base, self.namespace = spark, base.rstrip("/"), namespace

    def path(self, kind: str, key: str) -> str:
        if not re.fullmatch(r"[\w.-]+", key):
            raise ValueError(f"bad key {key!r}")
        return f"{self.base}/{self.namespace}/{kind}/{key}"

    def save(self, kind: str, key: str, tables: dict[str, DataFrame]) -> str:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path(kind, key)}/{name}")
        return self.path(kind, key)

    def load(self, kind: str, key: str, *names: str) -> dict[str, DataFrame]:
        try:
            return {n: self.spark.read.parquet(f"{self.path(kind, key)}/{n}") for n in names}
        except Exception as e:
            raise StoreError(f"cannot load {kind} '{key}': {type(e).__name__}") from e

    def save_knowledge(self, key: str = "default", **tables: DataFrame) -> str:
        return self.save(KNOWLEDGE, key, tables)

    def load_knowledge(self, key: str = "default") -> dict[str, DataFrame]:
        return self.load(KNOWLEDGE, key, "items", "facts", "relations", "documents")

    def save_graph(self, nodes: DataFrame, edges: DataFrame, key: str = "default") -> str:
        return self.save(GRAPH, key, {"nodes": nodes, "edges": edges})

    def load_graph(self, key: str = "default") -> tuple[DataFrame, DataFrame]:
        t = self.load(GRAPH, key, "nodes", "edges")
        return t["nodes"], t["edges"]


def read_knowledge_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lists of a knowledge base file as tables; the file must hold one of the four lists."""
    raw = _read_json(path)
    if not any(isinstance(raw.get(k), list) for k in ("entities", "concepts", "facts", "relations")):
        raise StoreError(f"{path}: no entities, concepts, facts or relations")
    df = spark.read.schema(KB_SCHEMA).option("multiLine", True).json(path)
    return {k: df.select(F.posexplode(k).alias("ord", "i")).select("ord", "i.*") for k in ("entities", "concepts", "facts", "relations", "documents")}


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = _read_json(path)
    if not isinstance(raw.get("nodes"), list) or not isinstance(raw.get("edges"), list):
        raise StoreError(f"{path}: a graph needs 'nodes' and 'edges'")
    df = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path)
    return tuple(df.select(F.posexplode(k).alias("ord", "i")).select("ord", "i.*") for k in ("nodes", "edges"))


def _read_json(path: str) -> dict:
    local = path.removeprefix("file://")
    if not os.path.isfile(local):
        raise StoreError(f"not a file: {path}")
    try:
        with open(local, encoding="utf-8-sig") as f:
            raw = json.load(f)
    except ValueError as e:
        raise StoreError(f"{path}: not valid JSON ({e})") from e
    if not isinstance(raw, dict):
        raise StoreError(f"{path}: must hold a JSON object")
    return raw


def write_pages(pages: DataFrame, folder: str, overwrite: bool = True) -> int:
    """Write (path, text[, part]) as UTF-8 files with exact names into a folder that all executors share; returns how many.

    The parts of a page come in order and are appended one by one, so a long page is never held. A file gets its name when
    it is whole.
    """
    rows = pages.withColumn("part", F.lit(0)) if "part" not in pages.columns else pages
    whole = F.col("section").isNull() if "section" in pages.columns else F.lit(True)
    lined = rows.select("path", "part", "text", whole.alias("whole")).repartition("path").sortWithinPartitions("path", "part")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, temporary, n = None, None, "", 0

        def close() -> None:
            if out is not None:
                if not ended:
                    out.write("\n")
                out.close()
                os.replace(temporary, os.path.join(folder, now))

        ended = True
        for b in batches:
            for path, text, one in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if path != now:
                    close()
                    now, n = path, n + 1
                    target = os.path.join(folder, path)
                    if not overwrite and os.path.exists(target):
                        raise FileExistsError(target)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    temporary = f"{target}.{os.getpid()}.part"
                    out = open(temporary, "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                else:
                    out.write("\n")
                ended = one
                out.write(text or "")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return lined.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def write_json(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines, one file a task: documents, knowledge, graph or issue tables with their nested columns.

    Nulls are kept, so the files read back with the same columns; ``read_json`` gives the rows again.
    """
    rows.write.mode(mode).option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)


def read_json(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Rows that ``write_json`` wrote, with the schema of ``like``; a broken line is an error."""
    return spark.read.schema(like.schema).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)


# --- layout of a shown graph ----------------------------------------------------------------------------------------

MAX_POSITIONS, MIN_ZOOM, MAX_ZOOM, LIMIT = 5000, 0.01, 100.0, 1e7


def clean_layout(update: dict, node_ids: set[str] | None = None) -> dict:
    """A layout with known nodes, finite numbers and a zoom within bounds."""

    def number(v) -> float | None:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or abs(v) > LIMIT:
            return None
        return round(float(v), 2)

    def pair(v) -> dict | None:
        x, y = (number(v.get("x")), number(v.get("y"))) if isinstance(v, dict) else (None, None)
        return None if x is None or y is None else {"x": x, "y": y}

    raw = update.get("positions") if isinstance(update.get("positions"), dict) else {}
    known = {k: p for k, v in raw.items() if (node_ids is None or k in node_ids) and (p := pair(v))}
    view = update.get("view") if isinstance(update.get("view"), dict) else {}
    zoom = number(view.get("zoom"))
    out = {"positions": dict(list(known.items())[:MAX_POSITIONS]), "view": {}, "search": str(update.get("search") or "")[:200]}
    if zoom is not None:
        out["view"]["zoom"] = min(MAX_ZOOM, max(MIN_ZOOM, zoom))
    if p := pair(view.get("pan")):
        out["view"]["pan"] = p
    return out


class LayoutStore:
    """One JSON file per graph key, replaced atomically; a broken file is set aside and read as empty."""

    def __init__(self, folder: str, key: str, node_ids: set[str] | None = None):
        self.path, self.node_ids = os.path.join(folder, f"{key}.json"), node_ids

    def load(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                return clean_layout(json.load(f), self.node_ids)
        except FileNotFoundError:
            return clean_layout({})
        except (ValueError, AttributeError):
            os.replace(self.path, self.path + ".broken")
            return clean_layout({})

    def save(self, update: dict) -> dict:
        state = self.load()
        new = clean_layout(update, self.node_ids)
        state["positions"] |= new["positions"]
        state["view"] |= new["view"]
        if "search" in update:
            state["search"] = new["search"]
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path + ".part", "w", encoding="utf-8") as f:
            json.dump(state, f, ensure_ascii=False)
        os.replace(self.path + ".part", self.path)
        return state

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def graph_payload(nodes: DataFrame, edges: DataFrame, limit: int = 20_000) -> dict:
    """Nodes and edges as JSON rows for a viewer; refuses graphs that no viewer can show."""
    n, e = nodes.limit(limit + 1).toJSON().collect(), edges.limit(limit + 1).toJSON().collect()
    if len(n) > limit or len(e) > limit:
        raise StoreError(f"the graph has more than {limit} nodes or edges")
    return {"nodes": [json.loads(x) for x in n], "edges": [json.loads(x) for x in e], "metadata": {"nodes": len(n), "edges": len(e)}}
