"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie in one array of symbols. An index maps every mergeable pair to
all its positions in the batch; the ranks in use are applied in ascending order, each to all its
positions at once, and the lists of the neighbouring pairs are updated. Word results are kept in
a bounded memory, so a frequent word is encoded once per worker.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers, and bytes of one: longer words are encoded anew in each batch.
KEPT_WORDS = 400_000
KEPT_BYTES = 64


def category_ranges(major: str, end: int) -> str:
    """A character class body of the code points below `end` whose general category begins with `major`."""
    inside = [unicodedata.category(chr(c))[0] == major for c in range(end)]
    escape = (lambda c: f"\\x{c:02x}") if end <= 256 else (lambda c: f"\\U{c:08x}")
    edges = np.flatnonzero(np.diff(np.array([False, *inside, False]).astype(np.int8)))
    return "".join(f"{escape(a)}-{escape(b - 1)}" for a, b in edges.reshape(-1, 2).tolist())


def word_pattern(split: str, end: int) -> str:
    """The split pattern for the standard re module over the code points below `end`, with letters and numbers written out as ranges.

    A word of letters is tried first, which is quicker and changes nothing: no other branch can
    begin with a letter.
    """
    head = "[\\p{L}]+|"
    if head in split:
        split = head + split.replace(head, "", 1)
    for a, b in (("\\p{L}", category_ranges("L", end)), ("\\p{N}", category_ranges("N", end)),
                 ("\\s", "\\t-\\r \\x85" + category_ranges("Z", end))):
        split = split.replace(a, b)
    if "\\p" in split:
        raise ValueError(f"this split pattern isn't supported: {split[:80]}")
    return split


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A word-end BPE read from a tokenizers file: NFC, lower case, a split pattern, byte symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, ident in [*vocab.items(), *self.special.items()]:
            self.tokens[ident] = token.encode()
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.base = len(self.tokens)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.base + b for a, b, _ in merges], np.int64)
        self.left, self.right, self.made = (np.array(c, np.int64) for c in zip(*merges))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        born = {c: r for r, (_, _, c) in enumerate(merges)}
        self.ordered = all(born.get(a, -1) < r and born.get(b, -1) < r for r, (a, b, _) in enumerate(merges))
        if not self.ordered or len(born) < len(merges):
            raise ValueError("a merge comes before its parts, so ranks can't be applied in one ascending pass")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = re.compile(word_pattern(split["pattern"]["Regex"], 0x110000))
        self.latin_words = re.compile(word_pattern(split["pattern"]["Regex"], 256).encode())
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.memory: dict[str | bytes | int, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if it never merges."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words (none of them empty), by the pair occurrence index, and where each word begins and ends."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        n = len(symbols)
        following = np.arange(1, n + 1)
        following[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        alive = np.ones(n, bool)

        at = np.flatnonzero(following >= 0)
        rank = self.pair_ranks(symbols[at], symbols[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        occurrences: dict[int, list[np.ndarray]] = {
            int(rank[c]): [p] for c, p in zip(cuts, np.split(at, cuts[1:]))} if len(at) else {}
        queue = list(occurrences)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            lists = occurrences.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            nxt = following[pos]
            ok = alive[pos] & (symbols[pos] == a) & (nxt >= 0)
            ok &= symbols[nxt] == b
            pos, nxt = pos[ok], nxt[ok]
            if a == b:  # in a run the leftmost pairs merge, and none shares a symbol with another
                keep, last = [], -1
                for i, (p, q) in enumerate(zip(pos.tolist(), nxt.tolist())):
                    if p != last:
                        keep.append(i)
                        last = q
                pos, nxt = pos[keep], nxt[keep]
            if not len(pos):
                continue
            symbols[pos] = new
            alive[nxt] = False
            after = following[nxt]
            following[pos] = after
            before[after[after >= 0]] = pos[after >= 0]
            starts = np.concatenate([before[pos], pos[after >= 0]])
            starts = starts[starts >= 0]
            ranks = self.pair_ranks(symbols[starts], symbols[following[starts]])
            starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
            if not len(starts):
                continue
            order = np.argsort(ranks, kind="stable")
            starts, ranks = starts[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for c, p in zip(cuts, np.split(starts, cuts[1:])):
                key = int(ranks[c])
                if key in occurrences:
                    occurrences[key].append(p)
                else:
                    occurrences[key] = [p]
                    heapq.heappush(queue, key)
        return symbols[alive], np.concatenate([[0], np.cumsum(alive)[ends - 1]])

    def pieces(self, text: str) -> list[str | bytes | int]:
        """Words after normalisation, and the ids of special tokens that stand in the text.

        Words of a text within Latin-1 come as Latin-1 bytes, which the pattern splits faster.
        """
        out: list[str | bytes | int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            if "Σ" in part:  # lower-cased alike at the end of a word
                part = part.replace("Σ", "σ")
            part = part.lower()
            try:
                out += self.latin_words.findall(part.encode("latin-1"))
            except UnicodeEncodeError:
                out += self.words.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.pieces(t) for t in texts]
        memory = self.memory
        if len(memory) > KEPT_WORDS:
            memory.clear()
        fresh = list(set().union(*split).difference(memory))
        memory.update((w, np.array(w, "<u4").tobytes()) for w in fresh if isinstance(w, int))
        fresh = [w for w in fresh if not isinstance(w, int)]
        ids, cuts = self.encode_words([(w.decode("latin-1") if isinstance(w, bytes) else w).encode() for w in fresh])
        packed, cuts = ids.astype("<u4").tobytes(), (cuts * 4).tolist()
        memory.update((w, packed[a:b]) for w, a, b in zip(fresh, cuts, cuts[1:]))
        find = memory.__getitem__
        out = [np.frombuffer(b"".join(map(find, words)), "<u4") for words in split]
        for w in fresh:
            if len(w) > KEPT_BYTES:
                del memory[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as a file without a decoder asks for."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids.tolist()]).decode()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _slices(texts: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about `size` characters, so a batch of long texts stays small in memory."""
    run, total = [], 0
    for text in texts:
        run.append(text)
        total += len(text)
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs` (doc_id, text).

    Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated
    results; other columns are not read; an empty table gives no rows. One pass, no shuffle.
    """
    path = path or vocabulary_path()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            out = []
            for texts in _slices([t or "" for t in batch["text"]]):
                for ids in bpe.encode_batch(texts):
                    out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, ids); null texts have no ids."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([i.astype("int32") for run in _slices([t or "" for t in texts])
                          for i in load(path).encode_batch(run)], dtype=object)

    return docs.select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) as (doc_id, text); a null list is null."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else load(path).decode(np.asarray(i)) for i in ids], dtype=object)

    return encoded.select("doc_id", text("ids").alias("text"))
