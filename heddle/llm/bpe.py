"""Encoding with a public byte-level BPE tokenizer, as recursive DuckDB queries per partition.

The texts of a partition are cut into words by the tokenizer's own pattern, each new
word becomes one row per byte token, and a recursive query contracts, in each word, the
pair of least rank until no pair is in the merge table.  All occurrences of that pair
that do not overlap are contracted in one step, leftmost first: a merge is ranked after
the merges that make its parts, so no pair that arises can come before the others.
"""

from __future__ import annotations

import ast
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Words kept per Python worker; beyond it the memory is emptied, results stay the same.
WORD_MEMORY = 400_000


def default_folder() -> str:
    return os.environ.get("HEDDLE_TOKENIZERS", "/opt/tokenizers")


def _byte_letters() -> dict[int, str]:
    """Byte to letter as in the vocabulary file: printable bytes stand for themselves,
    the others, in order, for the letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _load(folder: str, name: str) -> tuple[np.ndarray, dict[str, np.ndarray], str, list[bytes]]:
    """(id of each byte, merge table, pattern, bytes of each id)."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], _byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = {
        "l": np.array([vocab[a] for a, _ in pairs], "int32"),
        "r": np.array([vocab[b] for _, b in pairs], "int32"),
        "rank": np.arange(len(pairs), dtype="int32"),
        "id": np.array([vocab[a + b] for a, b in pairs], "int32"),
    }
    single = np.array([vocab[letters[b]] for b in range(256)], "int32")
    back = {c: b for b, c in letters.items()}
    content = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in back for c in token):
            content[i] = bytes(back[c] for c in token)
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        named = {t.id: node.value for node in ast.parse(f.read()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)}
    pattern = ast.literal_eval(named["PATTERN"])  # read, not run
    return single, merges, pattern, content


CONTRACT = """
with recursive s(w, pos, tok) using key (w, pos) as (
  select w, pos, tok from seed
  union
  (with cur as (
     select w, pos, tok from recurring.s where tok >= 0 and w in (select w from s)),
   near as (
     select w, pos, tok, row_number() over o as i, lead(tok) over o as next_tok, lead(pos) over o as next_pos
     from cur window o as (partition by w order by pos)),
   pairs as (
     select near.w, pos, next_pos, i, rank, id from near join merges on l = tok and r = next_tok),
   least as (
     select * from pairs qualify rank = min(rank) over (partition by w)),
   runs as (
     select *, i - row_number() over (partition by w order by i) as run from least),
   chosen as (
     select * from runs qualify (i - min(i) over (partition by w, run)) % 2 = 0)
   select w, pos, id from chosen
   union all
   select w, next_pos, -1 from chosen)
)
select w, list(tok order by pos) as ids from s where tok >= 0 group by w
"""


class Encoder:
    """Encodes word by word; keeps the words already seen."""

    def __init__(self, folder: str, name: str):
        self.single, merges, pattern, _ = _load(folder, name)
        self.pattern = regex.compile(pattern)
        self.words: dict[str, np.ndarray] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.register("merges_in", pd.DataFrame(merges))
        self.con.execute("create table merges as select * from merges_in")

    def learn(self, words: list[str]) -> None:
        """Encode new words in one recursive query."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), "int64", len(raw))
        flat = np.frombuffer(b"".join(raw), "uint8")
        starts = np.cumsum(lengths) - lengths
        seed = pd.DataFrame(
            {
                "w": np.repeat(np.arange(len(raw)), lengths),
                "pos": (np.arange(len(flat)) - np.repeat(starts, lengths)).astype("int32"),
                "tok": self.single[flat],
            }
        )
        self.con.register("seed", seed)
        done = self.con.execute(CONTRACT).fetchnumpy()
        self.con.unregister("seed")
        for w, ids in zip(done["w"].tolist(), done["ids"]):
            self.words[words[w]] = np.asarray(ids, "int32")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty ones."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.words) > WORD_MEMORY:
            self.words.clear()
        if fresh := {w for c in cut for w in c if w not in self.words}:
            self.learn(sorted(fresh))
        empty = np.empty(0, "int32")
        return [np.concatenate([self.words[w] for w in c]) if c else empty for c in cut]


def encode(df: DataFrame, id_col: str, text_col: str, folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty array; blanks and control codes are
    encoded like other text.  Ids repeat as their rows do.  Other columns are ignored.
    """
    folder = folder or default_folder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(folder, name)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "ids": encoder.encode(texts)})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, text): the token bytes joined in order by an ordered aggregation in DuckDB.

    Null ids give null, an empty array the empty text; an id outside the vocabulary
    counts as no bytes, bytes that are no UTF-8 as U+FFFD.
    """
    folder = folder or default_folder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        content = _load(folder, name)[3]
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.register("vocab_in", pd.DataFrame({"id": np.arange(len(content), dtype="int32"), "hex": [c.hex() for c in content]}))
        con.execute("create table vocab as select * from vocab_in")
        for batch in batches:
            lists = [None if i is None else np.asarray(i, "int32") for i in batch["ids"]]
            sizes = [0 if i is None else len(i) for i in lists]
            rows = pd.DataFrame(
                {
                    "d": np.repeat(np.arange(len(lists)), sizes),
                    "pos": np.concatenate([np.arange(n, dtype="int32") for n in sizes] or [np.empty(0, "int32")]),
                    "id": np.concatenate([i for i in lists if i is not None] or [np.empty(0, "int32")]),
                }
            )
            con.register("ids", rows)
            got = con.execute("select d, string_agg(hex, '' order by pos) as hex from ids join vocab using (id) group by d").fetchnumpy()
            con.unregister("ids")
            text = {int(d): bytes.fromhex(h).decode("utf-8", "replace") for d, h in zip(got["d"], got["hex"])}
            yield pd.DataFrame({"id": batch["id"], "text": [None if i is None else text.get(k, "") for k, i in enumerate(lists)]})

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
