"""Byte-level BPE encoding and decoding with recursive DuckDB queries in every partition.

A text is cut into the matches of the tokenizer's pattern. The distinct matches of a batch
that the worker has not met before become rows (word, tokens), at first one token for each byte.
A recursive query joins neighboring tokens with the merge table, contracts each word's
leftmost pair of minimum rank, and goes on with the words that had one, until none has. An
ordered aggregation then gives, by the vocabulary, the bytes that each word's ids decode to. A
text's ids are those of its matches in order.

Each task keeps the ids of what it has encoded, about twice ``CACHE_WORDS`` entries, and then
a second generation that starts with what is still met of the first. Nothing is shuffled. The
recursion takes one step for each merge of the longest word, so a match of more than
``LONG_BYTES`` bytes is merged by the same rule with a heap instead, and a match that is a token
as it stands is looked up.

Edges: a null text is encoded as an empty one: no ids. Texts are taken whole, whatever
their length. Repeated rows get equal results. The vocabulary file is a parameter, read from
where the workers have it installed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, values

CACHE_WORDS = 120_000
QUERY_WORDS = 12_000
LONG_BYTES = 96
TEXTS = 500

# The characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")

# A row is a word with its tokens. Of each word, ``best`` packs the pair of minimum rank,
# leftmost among equals: id, number of the tokens before it. A word without a pair is done.
_ENCODE = """
WITH RECURSIVE t(w, toks, done) AS (
  SELECT w, toks, false FROM start
  UNION ALL
  SELECT w, CASE WHEN best IS NULL THEN toks ELSE
      toks[:best & 65535] || [(best >> 32)::INTEGER] || toks[(best & 65535) + 3:] END,
    best IS NULL
  FROM t LEFT JOIN (
    SELECT w, min((m.id << 32) | k) AS best
    FROM (SELECT w, (unnest(toks[:-2])::BIGINT << 32) | unnest(toks[2:]) AS lr,
            unnest(range(len(toks) - 1)) AS k
          FROM t WHERE NOT done AND len(toks) > 1) JOIN merges m USING (lr)
    GROUP BY w) USING (w)
  WHERE NOT done
), ended AS MATERIALIZED (SELECT w, toks FROM t WHERE done)
SELECT w, len(toks) AS n, array_to_string(toks, ' ') AS ids, chars
FROM ended JOIN (
  SELECT w, string_agg(chars, '' ORDER BY pos) AS chars
  FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM ended)
    JOIN vocabulary USING (tok)
  GROUP BY w) USING (w)
ORDER BY w
"""

_DECODE = """
SELECT w, string_agg(chars, '' ORDER BY pos) AS chars FROM ids JOIN vocabulary USING (tok)
GROUP BY w ORDER BY w
"""


class Encoder:
    """A vocabulary of ranks, its pattern, and a worker's memory of encoded words."""

    def __init__(self, path: str, pattern: str):
        lines = open(path, "rb").read().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in
                      (line.split() for line in lines if line)}
        explicit = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
        self.pattern = regex.compile(explicit.replace(r"\s", f"[{SPACE}]"))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # Whether the pattern leaves runs of letters, with a blank before them or none, whole.
        letters = [chr(x) for x in (*range(65, 91), *range(97, 123))]
        self.whole = all(self.pattern.findall(t) == [t] for a in letters for b in letters
                         for t in (a + b, " " + a + b + a))
        # Ids of a chunk in text form; what it decodes to, if that is not the chunk itself.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        # Both tokens of a merge as one number.
        merges = [((self.ranks[b[:k]] << 32) | self.ranks[b[k:]], i)
                  for b, i in self.ranks.items()
                  for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        # A character for each byte of a token.
        self.tables = {
            "merges": pa.table(dict(zip(("lr", "id"), np.array(merges, np.int64).T))),
            "vocabulary": pa.table({"tok": pa.array(self.ranks.values(), pa.int32()),
                                    "chars": [b.decode("latin-1") for b in self.ranks]})}
        self._con = None

    @property
    def con(self) -> duckdb.DuckDBPyConnection:
        """The open connection, with the tables of merges and tokens."""
        if self._con is None:
            self._con = duckdb.connect(config={"threads": 1, "memory_limit": "100MB"})
            self._con.execute("SET temp_directory = ''")
            for name, table in self.tables.items():
                self._con.register("given", table)
                self._con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self._con.unregister("given")
        return self._con

    def forget(self) -> None:
        """Give up what has been encoded, so that an idle worker holds no memory of it."""
        self.known, self.older, self.odd = {}, {}, {}
        if self._con is not None:
            self._con.close()
            self._con = None

    def merged(self, word: bytes) -> list[int]:
        """Ids of one long word: the leftmost pair of minimum rank first, with a heap."""
        parts = {k: word[k:k + 1] for k in range(len(word))}
        after = {k: k + 1 for k in range(len(word))}
        before = {k: k - 1 for k in range(len(word))}

        def push(k: int) -> None:
            if k >= 0 and after[k] < len(word):
                joined = parts[k] + parts[after[k]]
                if joined in self.ranks:
                    heapq.heappush(heap, (self.ranks[joined], k, joined))

        heap: list[tuple[int, int, bytes]] = []
        for k in range(len(word)):
            push(k)
        while heap:
            _, k, joined = heapq.heappop(heap)
            if k not in parts or parts[k] + parts.get(after[k], b"") != joined:
                continue
            gone = after[k]
            if gone >= len(word):
                continue
            parts[k], after[k] = joined, after[gone]
            if after[k] < len(word):
                before[after[k]] = k
            del parts[gone]
            push(before[k])
            push(k)
        return [self.ranks[parts[k]] for k in sorted(parts)]

    def encode_words(self, found: list[bytes]) -> list[list[int]]:
        """Ids of non-empty words by the recursive query."""
        return [[int(i) for i in ids.split()] for ids, _, _ in self.coded(found)]

    def coded(self, found: list[bytes]) -> list[tuple[str, int, bytes]]:
        """(ids in text form, number of ids, bytes that they decode to) of non-empty words."""
        out: list = [None] * len(found)
        for k, word in enumerate(found):
            if word in self.ranks:  # a word that is a token is that token
                out[k] = (str(self.ranks[word]), 1, word)
            elif len(word) > LONG_BYTES:
                ids = self.merged(word)
                out[k] = (" ".join(map(str, ids)), len(ids), self.decode_words([ids])[0])
        some = [k for k, x in enumerate(out) if x is None]
        if some:
            ends = np.cumsum([0] + [len(found[k]) for k in some]).astype(np.int32)
            data = np.frombuffer(b"".join(found[k] for k in some), np.uint8)
            start = pa.table({"w": np.arange(len(some), dtype=np.int32),
                              "toks": pa.ListArray.from_arrays(ends, self.first[data])})
            self.con.register("start", start)
            result = self.con.sql(_ENCODE).to_arrow_table()
            for k, n, ids, text in zip(some, *(result.column(c).to_pylist()
                                               for c in ("n", "ids", "chars"))):
                out[k] = (ids, n, text.encode("latin-1"))
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of non-empty lists of ids by an ordered aggregation."""
        size = np.array([len(x) for x in ids])
        at = np.repeat(np.cumsum(size) - size, size)
        tok = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        table = pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), size),
                          "pos": (np.arange(len(tok)) - at).astype(np.int32), "tok": tok})
        self.con.register("ids", table)
        rows = self.con.sql(_DECODE).to_arrow_table().column("chars").to_pylist()
        return [x.encode("latin-1") for x in rows]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that the pattern matches independently of each other.

        A match crosses from a character that is not white space to white space nowhere,
        and takes in one blank before a word at most. So a text whose white space is
        single blanks and line ends may be cut before each of them.
        """
        if not text:
            return []
        if (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _DOUBLE)
                or _OTHER_SPACE.search(text)):
            return self.pattern.findall(text)
        parts: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append("\n")
            first, *rest = line.split(" ")
            parts.append(first)
            parts += [" " + x for x in rest]
        return parts

    def learn(self, new: set[str]) -> None:
        """Encode and decode chunks and keep the results."""
        alone, cut, older = [], {}, self.older
        for x in new:
            if self.whole and x.isascii() and x.lstrip(" ").isalpha() and x[:2] != "  ":
                alone.append(x)
            else:
                cut[x] = self.pattern.findall(x)
        words = set(alone)
        for m in set().union(*cut.values()).difference(self.known):
            if m in older:
                self.known[m] = older[m]
            else:
                words.add(m)
        # Words of like length take as many steps, so they share a query.
        words = sorted(words, key=len)
        for at in range(0, len(words), QUERY_WORDS):
            part = words[at:at + QUERY_WORDS]
            for m, word, (ids, _, text) in zip(part, words_ := [m.encode() for m in part],
                                               self.coded(words_)):
                self.known[m] = ids
                if text != word:
                    self.odd[m] = text
        for x, ms in cut.items():
            if x not in self.known:
                self.known[x] = " ".join([self.known[m] for m in ms])
                if self.odd and any(m in self.odd for m in ms):
                    self.odd[x] = b"".join([self.odd.get(m, m.encode()) for m in ms])

    def _learned(self, texts: pa.Array) -> Iterable[list[str]]:
        """For each text its chunks, which are known then.

        Only the chunks of a block of texts are held at once.
        """
        for at in range(0, len(texts), TEXTS):
            block = [self.chunks(t or "") for t in values(texts.slice(at, TEXTS))]
            seen = set().union(*block)
            if len(self.known) + len(seen) > 2 * CACHE_WORDS:
                self.older, self.known = self.known, {}
            for x in seen.difference(self.known).intersection(self.older):
                self.known[x] = self.older[x]
            seen.difference_update(self.known)
            if seen:
                self.learn(seen)
            del seen
            yield from block

    def _bytes(self, chunk: str) -> bytes:
        return self.odd[chunk] if chunk in self.odd else chunk.encode()

    def texts(self, texts: pa.Array) -> Iterable[list[tuple[str, int, bytes]]]:
        """For each text, its chunks as (ids in text form, number of ids, decoded bytes)."""
        for parts in self._learned(texts):
            yield [(self.known[x], self.known[x].count(" ") + 1, self._bytes(x)) if x
                   else ("", 0, b"") for x in parts]

    def whole_texts(self, texts: pa.Array) -> Iterable[tuple[str, bytes]]:
        """For each text, its ids in text form, and the bytes that they decode to.

        Every chunk has been decoded when it was encoded; most decode to themselves.
        """
        for parts in self._learned(texts):
            decoded = (b"".join([self._bytes(x) for x in parts]) if self.odd
                       else "".join(parts).encode())
            yield " ".join([self.known[x] for x in parts if x]), decoded


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column as array<int>."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        found = encoder(path, pattern).whole_texts(texts)
        ids = [[int(i) for i in x.split()] for x, _ in found]
        return pa.array(ids, pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of a column of ids; null for null."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        lists = rows.to_pylist()
        full = [k for k, x in enumerate(lists) if x]
        found = encoder(path, pattern).decode_words([lists[k] for k in full]) if full else []
        out = [None if x is None else b"" for x in lists]
        for k, b in zip(full, found):
            out[k] = b
        return pa.array(out, pa.binary())

    return run(ids)


def token_digest(text: Column, path: str, pattern: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, sha = encoder(path, pattern), hashlib.sha256
        try:
            for texts in batches:
                n, ids, decoded = [], [], []
                for x, b in coder.whole_texts(texts):
                    n.append(x.count(" ") + 1 if x else 0)
                    ids.append(sha(x.encode()).hexdigest())
                    decoded.append(sha(b).hexdigest())
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(decoded, pa.string())],
                    ["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            # The vocabulary stays for the worker's next task.
            coder.forget()
            give_back()

    return run(text)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of their decoded bytes."""
    rows = docs.select("doc_id", token_digest(F.col("text"), path, pattern).alias("found"))
    return rows.select("doc_id", "found.*")
