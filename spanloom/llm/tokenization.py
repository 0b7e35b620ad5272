"""Corpus encoding by a public byte-level BPE, as recursive DuckDB queries per partition.

A partition's distinct pieces become token-position rows; a recursive query joins neighbouring
tokens with the merge table and contracts each piece's minimum-rank pair until nothing
merges; an ordered aggregation reads the ids off. Documents are then strung together from
their pieces. The tokenizer's own splitter cuts the pieces, so whole texts are encoded as the
public library would.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Contractions in one recursive query; longer pieces go through it again.
ROUND = 24
#: Bytes of a piece encoded at once, how far windows of a longer one overlap, seams tried for each.
WINDOW, OVERLAP, SEAMS = 512, 128, 12
#: Pieces remembered between batches of a worker.
CACHE_PIECES = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


#: The byte-level splitter on ASCII, where no version of Unicode can disagree; white space spelt out.
_ASCII_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")

_STEP = """
  with recursive step(turn, piece, pos, tok) as (
    select 0, piece, pos, tok from active
    union all
    (with paired as (
       select turn, piece, pos, tok, lead(tok) over (partition by piece order by pos) as nxt from step),
     ranked as (
       select p.*, m.rank, m.id, min(m.rank) over (partition by piece) as best,
              row_number() over (partition by piece order by pos) as idx
       from paired p left join merges m on m.l = p.tok and m.r = p.nxt where turn < {turns}),
     hits as (
       select *, rank is not null and rank = best as hit from ranked where best is not null),
     runs as (
       select *, idx - row_number() over (partition by piece, hit order by idx) as run from hits),
     taken as (
       select *, hit and (row_number() over (partition by piece, hit, run order by idx)) % 2 = 1 as take from runs),
     kept as (
       select *, coalesce(lag(take) over (partition by piece order by pos), false) as gone from taken)
     select turn + 1, piece, pos, case when take then id else tok end from kept where not gone))
  select piece, list(tok order by pos) as ids, max(turn) as turn
  from (select *, max(turn) over (partition by piece) as last from step) where turn = last group by piece
"""


class PieceEncoder:
    """Encodes pieces with DuckDB; one for each worker process and tokenizer file."""

    def __init__(self, path: str):
        import duckdb
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        alphabet = byte_alphabet()
        # ASCII bytes also by their own character: pieces of ASCII texts are used as they are.
        self.byte_ids = {chr(b): vocab[alphabet[b]] for b in range(128)} | {c: vocab[c] for c in alphabet}
        self.con = duckdb.connect(config={"threads": "1"})
        merges = pa.table({"l": [vocab[a] for a, _ in pairs], "r": [vocab[b] for _, b in pairs], "rank": range(len(pairs)), "id": [vocab[a + b] for a, b in pairs]})
        self.con.register("merges_in", merges)
        self.con.execute("create table merges as select l::int l, r::int r, rank::int rank, id::int id from merges_in")
        self.con.unregister("merges_in")
        self.names = {i: name for name, i in vocab.items()}
        self.vocab = pa.table({"id": pa.array(list(vocab.values()), pa.int32()), "piece": list(vocab.keys())})
        self.con.register("vocab", self.vocab)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.cache: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if text.isascii():
            return _ASCII_PIECES.findall(text)
        return [piece for piece, _ in self.splitter.pre_tokenize_str(text)]

    def contract(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each of ``pieces``, by the recursive query until nothing merges."""
        state = [[self.byte_ids[c] for c in piece] for piece in pieces]
        active = list(range(len(pieces)))
        while active:
            lengths = [len(state[i]) for i in active]
            rows = pa.table(
                {
                    "piece": pa.array([i for i, n in zip(active, lengths) for _ in range(n)], pa.int32()),
                    "pos": pa.array(list(chain.from_iterable(range(n) for n in lengths)), pa.int32()),
                    "tok": pa.array(list(chain.from_iterable(state[i] for i in active)), pa.int32()),
                }
            )
            self.con.register("active", rows)
            found = self.con.execute(_STEP.format(turns=ROUND)).fetchall()
            self.con.unregister("active")
            active = []
            for piece, ids, turn in found:
                state[piece] = ids
                if turn >= ROUND:
                    active.append(piece)
        return state

    def contract_long(self, piece: str) -> list[int]:
        """Ids of one very long piece, from overlapping windows.

        A sequence of tokens is the encoding of its text exactly if every two neighbours are
        the encoding of theirs. Neighbours inside a window are; at a seam the two tokens are
        encoded together to see. Where no seam of an overlap holds, the whole piece is
        contracted at once.
        """
        starts = list(range(0, max(1, len(piece) - OVERLAP), WINDOW - OVERLAP))
        windows = self.contract([piece[s : s + WINDOW] for s in starts])
        ends = []
        for start, ids in zip(starts, windows):
            at, bounds = start, {}
            for k, i in enumerate(ids):
                bounds[at] = k
                at += len(self.names[i])
            ends.append(bounds)
        seams = []
        for w in range(1, len(starts)):
            middle = starts[w] + OVERLAP // 2
            both = sorted((c for c in ends[w] if c in ends[w - 1] and ends[w][c] and ends[w - 1][c]), key=lambda c: abs(c - middle))
            seams.append(both[:SEAMS])
        tries = {(w, c): (windows[w][ends[w][c] - 1], windows[w + 1][ends[w + 1][c]]) for w, cuts in enumerate(seams) for c in cuts}
        pairs = list(dict.fromkeys(tries.values()))
        sound = {p for p, ids in zip(pairs, self.contract([self.names[a] + self.names[b] for a, b in pairs])) if ids == list(p)}
        out, low = [], 0
        for w, cuts in enumerate(seams):
            cut = next((c for c in cuts if tries[w, c] in sound), None)
            if cut is None:
                return self.contract([piece])[0]
            out += windows[w][low : ends[w][cut]]
            low = ends[w + 1][cut]
        return out + windows[-1][low:]

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of distinct new ``pieces`` into the cache."""
        short = [p for p in pieces if len(p) <= WINDOW]
        self.cache.update(zip(short, self.contract(short)))
        for piece in pieces:
            if len(piece) > WINDOW:
                self.cache[piece] = self.contract_long(piece)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.cache))
        if new:
            self.learn(new)
        cache = self.cache
        return [list(chain.from_iterable(cache[p] for p in pieces)) for pieces in split]

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        """Texts of id lists: token-position rows join the vocabulary, strung together in order."""
        rows = pa.table({"doc": pa.array([d for d, x in enumerate(ids) for _ in x or ()], pa.int32()), "pos": pa.array([k for x in ids for k in range(len(x or ()))], pa.int32()), "id": pa.array([i for x in ids for i in x or ()], pa.int32())})
        self.con.register("coded", rows)
        found = dict(self.con.execute("select doc, string_agg(v.piece, '' order by pos) from coded join vocab v using (id) group by doc").fetchall())
        self.con.unregister("coded")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        return [bytes(back[c] for c in found.get(d, "")).decode("utf-8", "replace") for d in range(len(ids))]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _chunks(column: pa.Array, most_bytes: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text: long texts don't pile up in one round."""
    low, held = 0, 0
    for at, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        if held and held + n > most_bytes:
            yield low, at
            low, held = at, 0
        held += n
    if low < len(column):
        yield low, len(column)


def _encode_batches(path: str, count_only: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        tool = encoder(path)
        for batch in batches:
            for low, high in _chunks(batch.column(1)):
                ids = tool.encode(batch.column(1).slice(low, high - low).to_pylist())
                out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), out], names=["_id", "_out"])

    return work


def _map(df: DataFrame, key: str, text: str, tokenizer_dir: str, tokenizer: str, count_only: bool, out: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = T.LongType() if count_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_out", kind)])
    mapped = spread(rows).mapInArrow(_encode_batches(os.path.join(tokenizer_dir, tokenizer), count_only), schema)
    return mapped.select(F.col("_id").alias(key), F.col("_out").alias(out))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(key, ids) of every row: whole texts, no special tokens; no shuffle.

    Null and empty texts give an empty list. A special token's spelling in a text is encoded
    as ordinary text. Repeated keys keep their rows; other columns are ignored.
    """
    return _map(df, key, text, tokenizer_dir, tokenizer, False, "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(key, n_tokens) by the same encoder; null and empty texts have 0 tokens."""
    return _map(df, key, text, tokenizer_dir, tokenizer, True, "n_tokens")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(key, text) of id lists; null and empty lists give the empty text."""
    path = os.path.join(tokenizer_dir, tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tool.decode(part.column(1).to_pylist()), pa.string())], names=["_id", "_out"])

    rows = df.select(F.col(key).alias("_id"), F.col(ids).cast("array<int>").alias("_ids"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_out", T.StringType())])
    return rows.mapInArrow(work, schema).select(F.col("_id").alias(key), F.col("_out").alias("text"))
