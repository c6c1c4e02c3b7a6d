"""Graphs on disk, a catalog of them, the documents registry, and layered settings."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT_VERSION = "1.1"


class GraphStoreError(RuntimeError):
    """A graph that cannot be read or written."""


class UnknownGraphError(KeyError):
    """A name that the catalog does not have."""


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, **meta) -> dict:
    """Write a new version beside the old one, then turn the pointer; readers never see half a graph."""
    version = f"v{time.time_ns()}"
    target = os.path.join(path, version)
    nodes.write.parquet(os.path.join(target, "nodes"))
    edges.write.parquet(os.path.join(target, "edges"))
    spark = nodes.sparkSession
    info = {"format_version": FORMAT_VERSION, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "node_count": spark.read.parquet(os.path.join(target, "nodes")).count(), "edge_count": spark.read.parquet(os.path.join(target, "edges")).count(), **meta}
    with open(os.path.join(target, "meta.json"), "w", encoding="utf-8") as f:
        json.dump(info, f)
    pointer = os.path.join(path, "CURRENT")
    with open(pointer + ".new", "w", encoding="utf-8") as f:
        f.write(version)
    os.replace(pointer + ".new", pointer)
    return info


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, metadata); another format version is only noted in the metadata."""
    try:
        with open(os.path.join(path, "CURRENT"), encoding="utf-8") as f:
            target = os.path.join(path, f.read().strip())
        with open(os.path.join(target, "meta.json"), encoding="utf-8") as f:
            meta = json.load(f)
    except (OSError, ValueError) as e:
        raise GraphStoreError(f"no graph at {path}: {e}") from e
    if meta.get("format_version") != FORMAT_VERSION:
        meta["warning"] = f"format {meta.get('format_version')} instead of {FORMAT_VERSION}"
    return spark.read.parquet(os.path.join(target, "nodes")), spark.read.parquet(os.path.join(target, "edges")), meta


@dataclass
class GraphEntry:
    name: str
    path: str
    description: str = ""
    source_url: str = ""
    config_dir: str = ""

    def location(self) -> str:
        p = os.path.expanduser(self.path)
        return p if os.path.isabs(p) else os.path.normpath(os.path.join(self.config_dir or ".", p))


@dataclass
class Catalog:
    """Named graphs, ``default`` first; a graph is read again once its pointer file changes."""

    spark: SparkSession
    entries: list[GraphEntry] = field(default_factory=list)
    cache: dict = field(default_factory=dict)

    def get(self, name: str = "default") -> tuple[DataFrame, DataFrame, dict]:
        entry = next((e for e in self.entries if e.name == name), None)
        if entry is None:
            raise UnknownGraphError(f"{name}; known: {[e.name for e in self.entries]}")
        path = entry.location()
        try:
            st = os.stat(os.path.join(path, "CURRENT"))
        except OSError as e:
            raise GraphStoreError(f"graph {name} is missing at {path}") from e
        stamp = (st.st_mtime_ns, st.st_size)
        if name not in self.cache or self.cache[name][0] != stamp:
            self.cache[name] = (stamp, load_graph(self.spark, path))
        return self.cache[name][1]

    def listing(self) -> DataFrame:
        rows = [(e.name, e.location(), e.description, e.source_url, os.path.exists(os.path.join(e.location(), "CURRENT"))) for e in sorted(self.entries, key=lambda e: e.name != "default")]
        return self.spark.createDataFrame(rows, "name string, path string, description string, source_url string, available boolean")


def load_docs(spark: SparkSession, registry: str) -> DataFrame:
    """(id, title, summary, category, tags, path) of a YAML registry; an invalid one, or a missing file, fails the load."""
    import yaml

    with open(registry, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict) or not isinstance(data.get("documents"), list):
        raise ValueError(f"{registry}: no list of documents")
    rows = []
    for d in data["documents"]:
        if not isinstance(d, dict) or not all(isinstance(d.get(k), str) and d[k] for k in ("id", "title", "category", "path")):
            raise ValueError(f"{registry}: incomplete entry {d!r}")
        full = os.path.join(os.path.dirname(registry), d["path"])
        if not os.path.isfile(full):
            raise ValueError(f"{registry}: missing file {full}")
        rows.append((d["id"], d["title"], d.get("summary"), d["category"], list(d.get("tags") or []), full))
    return spark.createDataFrame(rows, "id string, title string, summary string, category string, tags array<string>, path string")


def get_document(docs: DataFrame, doc_id: str) -> dict | None:
    """A document with its content, or None."""
    row = docs.where(docs.id == doc_id).first()
    if row is None:
        return None
    with open(row["path"], encoding="utf-8") as f:
        return row.asDict() | {"content": f.read()}


def deep_merge(base: dict, overlay: dict) -> dict:
    """Overlay wins leaf by leaf."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def env_settings(prefix: str, env: dict[str, str] | None = None) -> dict:
    """PREFIX_A__B=x as {"a": {"b": "x"}}."""
    out: dict = {}
    for k, v in (env if env is not None else dict(os.environ)).items():
        if k.startswith(prefix + "_") and "__" in k[len(prefix) + 1 :]:
            keys = k[len(prefix) + 1 :].lower().split("__")
            at = out
            for part in keys[:-1]:
                at = at.setdefault(part, {})
            at[keys[-1]] = v
    return out


def fill_placeholders(value, env: dict[str, str] | None = None):
    """${NAME} in any string replaced from the environment; unknown names stay."""
    import re

    env = env if env is not None else dict(os.environ)
    if isinstance(value, dict):
        return {k: fill_placeholders(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [fill_placeholders(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m.group(1), m.group()), value) if isinstance(value, str) else value


def merge_named(first: list[dict], second: list[dict]) -> list[dict]:
    """Union of two lists by ``name``: the second wins, the position of the first stays."""
    later = {x["name"]: x for x in second}
    return [later.pop(x["name"], x) for x in first] + [x for x in second if x["name"] in later]


def layered(user: dict, project: dict, env: dict, lists: tuple[str, ...] = ("graphs",)) -> dict:
    """User settings, then project settings, then the environment; named lists are united."""
    out = deep_merge(deep_merge(user, project), env)
    for k in lists:
        if k in user or k in project:
            out[k] = merge_named(user.get(k, []), project.get(k, []))
    return fill_placeholders(out)


def save_json(df: DataFrame, path: str, root: str = ".") -> int:
    """All rows as one JSON file under ``root``; other places are refused.

    The rows pass the driver partition by partition, never all at once; for results that no
    single file should hold there is ``df.write.json``.
    """
    full, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base:
        raise ValueError(f"{path} is outside {root}")
    n = 0
    with open(full, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("r")).toLocalIterator():
            f.write((",\n" if n else "\n") + row["r"])
            n += 1
        f.write("\n]\n")
    return n


def choose(catalog: Catalog, graph_file: str | None = None, graph_name: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """The graph a command means: a file goes before a name, a name before the default one."""
    if graph_file:
        if not os.path.exists(os.path.join(graph_file, "CURRENT")):
            raise GraphStoreError(f"no graph at {graph_file}")
        return load_graph(catalog.spark, graph_file)
    return catalog.get(graph_name or "default")


def graph_listing(catalog: Catalog) -> dict:
    """The listing of all graphs with their number; one row a configured graph."""
    docs = [r.asDict() for r in catalog.listing().collect()]
    return {"docs": docs, "count": len(docs)}
