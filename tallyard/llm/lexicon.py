"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

The corpus' frequent words are compiled, with their id sequences, into a minimal acyclic automaton: equal suffixes
share states, and the number of words that a path skips numbers the words, so the outputs are one flat table. The file
lies in the shared folder and executors map it into memory. A word that it lacks is merged exactly, pair by pair.
Which words are in the automaton changes the speed only, never an id.
"""

from __future__ import annotations

import base64
import heapq
import mmap
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import put_file

#: How the vocabulary's authors split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the adjacent pair of least rank, leftmost first, becomes one piece. A heap over
    a linked list keeps words of any length at n log n."""
    n = len(word)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(word[prv[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, prv[i], end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


# ------------------------------------------------------------------- automaton


def compile_automaton(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words with their id lists, as one block of bytes.

    Words are added in sorted order; once a word leaves a branch, the branch's states are replaced by equal ones that
    exist already. An arc carries how many words sort before those behind it, so a word's arcs sum to its number.
    """
    arcs: list[dict[int, int]] = [{}]
    final, known, path = [False], {}, [0]

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            s = path.pop()
            form = (final[s], tuple(arcs[s].items()))
            same = known.setdefault(form, s)
            if same != s:
                up = arcs[path[-1]]
                up[next(reversed(up))] = same

    before = b""
    ordered = sorted(words)
    for w in ordered:
        k = 0
        while k < min(len(w), len(before)) and w[k] == before[k]:
            k += 1
        freeze(k)
        for c in w[k:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = w
    freeze(0)
    # number the states that remain, children first, and count the words below each
    number, below, order = {}, {}, []
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            below[s] = int(final[s]) + sum(below[t] for t in arcs[s].values())
            number[s] = len(order)
            order.append(s)
        elif s not in number:
            number[s] = -1
            stack.append((s, True))
            stack += [(t, False) for t in arcs[s].values() if t not in number]
    rows = []
    for s in order:
        skipped = int(final[s])
        for c, t in sorted(arcs[s].items()):
            rows.append((number[s] * 256 + c, number[t], skipped))
            skipped += below[t]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    ends = np.array([final[s] for s in order], np.int64)
    lists = [words[w] for w in ordered]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    ids = np.array([i for x in lists for i in x], np.int64)
    longest = max(map(len, ordered), default=0)
    blocks = [table[:, 0], table[:, 1], table[:, 2], ends, starts, ids]
    head = struct.pack("<8q", number[0], longest, *[len(b) for b in blocks])
    return head + b"".join(np.ascontiguousarray(b).tobytes() for b in blocks)


class Automaton:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, self.longest, *sizes = struct.unpack_from("<8q", data)
        at, blocks = 64, []
        for n in sizes:
            blocks.append(np.frombuffer(data, np.int64, n, at))
            at += 8 * n
        self.key, self.to, self.skip, self.final, self.starts, self.ids = blocks

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it isn't held. All words take their k-th step together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return found
        lens = np.fromiter(map(len, words), np.int64, n)
        live = np.flatnonzero((lens > 0) & (lens <= self.longest))
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        k = 0
        while live.size:
            want = state[live] * 256 + flat[start[live] + k]
            at = np.searchsorted(self.key, want)
            hit = self.key[np.minimum(at, len(self.key) - 1)] == want
            live, at = live[hit], at[hit]
            state[live], total[live] = self.to[at], total[live] + self.skip[at]
            k += 1
            over = lens[live] == k
            done = live[over]
            ok = done[self.final[state[done]] == 1]
            found[ok] = total[ok]
            live = live[~over]
        return found


# ---------------------------------------------------------------------- corpus


def frequent_words(texts: DataFrame, text: str, size: int, longest: int = 48) -> list[str]:
    """The ``size`` words that the whole corpus holds most often, of at most ``longest`` bytes; seen twice at least."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))).alias("w"))
    counts = words.where(F.octet_length("w") <= longest).groupBy("w").count().where("count > 1")
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(size).collect()]


def encode_ids(df: DataFrame, key: str, text: str, vocabulary: str | None = None, lexicon_size: int = 32_768) -> DataFrame:
    """``<key>, ids array<int>``: the ids of each text without special tokens; one row for each input row.

    An empty text and a null text give an empty list. Strings of special tokens are ordinary text. ``vocabulary``: rank
    file of a byte-level BPE. ``lexicon_size`` bounds the automaton; it never changes an id.
    """
    spark = df.sparkSession
    ranks = read_ranks(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    words = [w.encode() for w in frequent_words(df, text, lexicon_size)]
    name = put_file(spark, compile_automaton({w: merge_word(w, ranks) for w in words}), "lexicon")
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        automaton, find, ranks, merged = Automaton(SparkFiles.get(name)), regex.compile(PATTERN).findall, shared.value, {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                number: dict[str, int] = {}
                seq, per_text = [], []
                for t in b.column(1).to_pylist():
                    found = find(t) if t else []
                    seq += [number.setdefault(w, len(number)) for w in found]
                    per_text.append(len(found))
                unique = [w.encode() for w in number]
                held = automaton.numbers(unique)
                size = np.zeros(len(unique), np.int64)
                ok = held >= 0
                size[ok] = automaton.starts[held[ok] + 1] - automaton.starts[held[ok]]
                extra: dict[int, list[int]] = {}
                for i in np.flatnonzero(~ok):
                    w = unique[i]
                    if (ids := merged.get(w)) is None:
                        ids = merge_word(w, ranks)
                        if len(w) <= 64:  # the memory of merged words is bounded: 100,000 short ones
                            if len(merged) >= 100_000:
                                merged.clear()
                            merged[w] = ids
                    extra[i] = ids
                    size[i] = len(ids)
                # one table of the portion's words, then one gather for all texts
                at = np.concatenate([[0], np.cumsum(size)])
                table = np.empty(at[-1], np.int32)
                for i in range(len(unique)):
                    table[at[i] : at[i + 1]] = extra[i] if held[i] < 0 else automaton.ids[automaton.starts[held[i]] : automaton.starts[held[i] + 1]]
                w = np.array(seq, np.int64)
                n = size[w]
                ends = np.cumsum(n)
                flat = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[w] - (ends - n), n)] if len(w) else np.empty(0, np.int32)
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")




def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_ids(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
