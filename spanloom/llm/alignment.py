"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two token sequences over the same bytes are read in step: the side that lags reads its next token,
and the state is the side that leads with the bytes that the other still lacks. Transitions are
memoised by residual and token; a group closes wherever the residual is empty.

A text whose spaces all stand between two other characters is cut into words there. Neither tokenizer
joins anything over such a place (the pre-tokenizer of one ends a word there, no piece of the other holds
a space after another character, which is checked on loading), so both end a token there, and the
groups of a word are remembered. Other texts are aligned whole. How often each pair of ids ends together in the whole
corpus is counted from the stored links and looked up in bounded slices of the pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import _slices, byte_symbols, vocabulary_path
from spanloom.llm.common import stored

#: Words that a worker remembers, characters of the longest of them, and states of the transducer it keeps.
KEPT_WORDS = 500_000
KEPT_CHARS = 64
KEPT_STATES = 1_000_000
#: Pairs of one looked-up slice (17 bytes each, broadcast) and links counted at once in a task.
SLICE_PAIRS = 2_000_000
LINKS = 4_000_000

#: Characters of texts aligned together, whose new words are in memory at once.
SLICE_CHARS = 1 << 20
#: Characters of words encoded as one text.
BLOCK = 8192
#: Characters beside which a text isn't cut, besides white space: what older tables take for it, and the sign that a piece has for a space.
_NO_CUT = "\u180e\u200b\ufeff\u2581"


class Transducer:
    """Aligns token ids of sides 0 and 1, whose tokens' bytes are given.

    A state is a dictionary of the transitions met so far, from a token of the lagging side to the
    next state; under `LEADS` it holds the leading side, under `REST` the residual bytes.
    """

    LEADS, REST = -1, -2

    def __init__(self, left: list[bytes], right: list[bytes]) -> None:
        self.tokens = (left, right)
        self.clear()

    def clear(self) -> None:
        self.start: dict = {self.LEADS: 1, self.REST: b""}      # side 0 reads first
        self.states = {(1, b""): self.start}

    def move(self, state: dict, token: int) -> dict | None:
        """The state after the lagging side reads `token`, None if the bytes disagree; a new transition is kept."""
        side, rest = state[self.LEADS], state[self.REST]
        data = self.tokens[1 - side][token]
        if rest.startswith(data):
            side, rest = side, rest[len(data):]
        elif data.startswith(rest):
            side, rest = 1 - side, data[len(rest):]
        else:
            return None
        side = side if rest else 1
        to = state[token] = self.states.setdefault((side, rest), {self.LEADS: side, self.REST: rest})
        return to

    def cuts(self, left: list[int], right: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of either side stand before the end of each group; None if the two don't spell the same bytes."""
        if len(self.states) > KEPT_STATES:
            self.clear()
        start, leads, move = self.start, self.LEADS, self.move
        rest_left, rest_right = iter(left), iter(right)
        ends, i, j = ([], []), 0, 0
        put_left, put_right = ends[0].append, ends[1].append
        for token in rest_left:
            i += 1
            state = start.get(token) or move(start, token)
            while state is not start:
                if state is None:
                    return None
                if state[leads]:
                    token = next(rest_left, None)
                    i += 1
                else:
                    token = next(rest_right, None)
                    j += 1
                if token is None:
                    return None
                state = state.get(token) or move(state, token)
            put_left(i)
            put_right(j)
        return ends if j == len(right) else None


class Kept:
    """Results of words: the groups in decimal, packed links, and the number of A ids with that of B ids above it."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.results: tuple[list[bytes], list[bytes], list[int]] = ([], [], [])

    def add(self, word: str, result: tuple[bytes, bytes, int]) -> None:
        self.index[word] = len(self.results[0])
        for column, value in zip(self.results, result):
            column.append(value)

    def of(self, word: str) -> tuple[bytes, bytes, int]:
        at = self.index[word]
        return tuple(column[at] for column in self.results)


#: A word, or text, that a tokenizer spells with other bytes, and one that has to stay with its neighbours.
MISSPELLED, IRREGULAR = -1, -2


class Aligned(NamedTuple):
    """A text's tokens of A and of B, its groups in decimal, and its links as packed codes."""

    n_a: int
    n_b: int
    groups: bytes
    links: bytes


class Pair:
    """Both tokenizers and their transducer in one worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.quick = quick_encoder(byte_path)
        raw = {s: i for i, s in enumerate(byte_symbols())}
        size = self.a.get_vocab_size()
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        a_bytes = [special[i].encode() if i in special else bytes(raw[c] for c in self.a.id_to_token(i)) for i in range(size)]
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if any(b" " in t.lstrip(b" ") for t in b_bytes):
            raise ValueError("a piece joins words, so texts can't be cut at spaces")
        self.width = len(b_bytes)
        if size * self.width > 1 << 32:
            raise ValueError("pairs of ids don't fit into 32 bits")
        self.transducer = Transducer(a_bytes, b_bytes)
        self.sizes = [np.array([len(t) for t in side]) for side in (a_bytes, b_bytes)]
        #: decimal ids with what can follow them: another id of the group, the other side, the next group
        self.decimals = [np.array([f"{i}{after}" for i in range(max(size, self.width))], object) for after in ",|;"]
        self.kept, self.older = Kept(), Kept()

    def a_ids(self, texts: list[str], quick: bool) -> list[list[int]]:
        if quick and self.quick:
            return [self.quick(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def align(self, texts: list[str], sizes: list[int], quick: bool = False) -> list[tuple[bytes, bytes, int]] | None:
        """Aligns each text, with a space before it, and gives the results of its stretches, whose bytes are `sizes` in order.

        All texts go through the transducer as one sequence, as each ends a group. None if a text isn't
        spelled with its bytes on both sides.
        """
        full = [" " + t for t in texts]
        data = b"".join([t.encode() for t in full])
        flat, spelled = [], []
        for side, found in enumerate((self.a_ids(full, quick), self.b.encode(texts, num_threads=1))):
            flat.append(list(itertools.chain.from_iterable(found)))
            tokens = self.transducer.tokens[side]
            if b"".join([tokens[i] for i in flat[side]]) != data:
                return None
            spelled.append(np.cumsum(self.sizes[side][np.array(flat[side], np.int64)]))
        cuts = self.transducer.cuts(*flat)
        if cuts is None:
            return None
        a, b = (np.array(x, np.int64) for x in flat)
        a_cut, b_cut = (np.array(x, np.int64) for x in cuts)
        # where each token stands when a group's A ids come before its B ids
        place_a = np.arange(len(a)) + np.repeat(b_cut - np.diff(b_cut, prepend=0), np.diff(a_cut, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(a_cut, np.diff(b_cut, prepend=0))
        parts = np.empty(len(a) + len(b), object)
        inner, middle, last = self.decimals
        parts[place_a], parts[place_b] = inner[a], inner[b]
        parts[place_a[a_cut - 1]], parts[place_b[b_cut - 1]] = middle[a[a_cut - 1]], last[b[b_cut - 1]]
        parts = parts.tolist()
        links = (a[a_cut - 1] * self.width + b[b_cut - 1]).astype("<u4").tobytes()
        ends = np.searchsorted(spelled[0][a_cut - 1], np.cumsum(sizes))     # the last group of each stretch
        out, i, j, g = [], 0, 0, 0
        for k, m, h in zip(a_cut[ends].tolist(), b_cut[ends].tolist(), (ends + 1).tolist()):
            out.append(("".join(parts[i + j:k + m])[:-1].encode(), links[4 * g:4 * h], (k - i) + (m - j << 32)))
            i, j, g = k, m, h
        return out

    def align_words(self, words: list[str], quick: bool) -> list[tuple[bytes, bytes, int]]:
        """Results of words that begin and end with characters at which texts are cut; blocks of them are encoded as one text, `quick` if they are short and ASCII."""
        blocks, sizes, size = [[]], [len(w.encode()) + 1 for w in words], 0
        for word, n in zip(words, sizes):
            if size > BLOCK:
                blocks.append([])
                size = 0
            blocks[-1].append(word)
            size += n
        found = self.align([" ".join(b) for b in blocks], sizes, quick) if words else []
        if found is None:
            found = [(self.align([w], [n]) or [(b"", b"", MISSPELLED)])[0] for w, n in zip(words, sizes)]
        return found

    def align_text(self, text: str) -> Aligned | None:
        """A text by itself; None if it isn't spelled with its bytes."""
        found = self.align([text], [len(text.encode()) + 1])
        return found and Aligned(found[0][2] & 0xFFFFFFFF, found[0][2] >> 32, *found[0][:2])

    def align_texts(self, texts: list[str]) -> list[Aligned | None]:
        """Texts word by word, words remembered; texts whose spaces don't all stand between other characters, or with a misspelled word, whole."""
        split = [t.split(" ") for t in texts]
        if len(self.kept.index) > KEPT_WORDS // 2:
            self.kept, self.older = Kept(), self.kept
        kept, older = self.kept, self.older
        needed = set().union(*split).difference(kept.index)
        for w in needed.intersection(older.index):
            kept.add(w, older.of(w))
        fresh = [w for w in needed if w not in kept.index]
        joined = [bool(w) and w[0] not in _NO_CUT and w[-1] not in _NO_CUT and not (w[0].isspace() or w[-1].isspace()) for w in fresh]
        for w, ok in zip(fresh, joined):
            if not ok:
                kept.add(w, (b"", b"", IRREGULAR))
        words = list(itertools.compress(fresh, joined))
        plain = [w.isascii() and len(w) <= KEPT_CHARS for w in words]
        for quick in (True, False):
            part = [w for w, p in zip(words, plain) if p == quick]
            for w, result in zip(part, self.align_words(part, quick)):
                kept.add(w, result)
        groups, links, counts = (column.__getitem__ for column in kept.results)
        find, out = kept.index.__getitem__, []
        for text, words in zip(texts, split):
            at = list(map(find, words))
            n = list(map(counts, at))
            if min(n) < 0:
                out.append(self.align_text(text))
            else:
                total = sum(n)
                out.append(Aligned(total & 0xFFFFFFFF, total >> 32, b";".join(map(groups, at)), b"".join(map(links, at))))
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del kept.index[w]
        return out


def quick_encoder(byte_path: str):
    """A function from ASCII text to the ids of A, by the file's own ranks; None if the file parts words otherwise or its ids aren't in the order of its merges.

    On ASCII both libraries part words alike, as their tables of letters and digits agree there.
    """
    import public_tokenizers
    import tiktoken

    with open(byte_path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    model = spec["model"]
    raw = {s: i for i, s in enumerate(byte_symbols())}
    made = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(made)) or any(vocab[c] >= 256 for c in raw):
        return None
    ranks = {bytes(raw[c] for c in token): i for token, i in vocab.items() if i < 256 + len(made)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _paths(byte_path: str | None, piece_path: str | None) -> tuple[str, str]:
    return byte_path or vocabulary_path("byte_bpe_50k.json"), piece_path or vocabulary_path("piece_bpe_32k.model")


def align_groups(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, groups): an array of structs of the ids of each group, null where a text has no tokens."""
    paths = _paths(byte_path, piece_path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(*paths)
        ids = lambda s: [int(x) for x in s.split(",")]
        for batch in batches:
            groups = []
            for texts in _slices([t or "" for t in batch["text"]], SLICE_CHARS):
                for text, got in zip(texts, pair.align_texts(texts)):
                    groups.append([dict(zip(("a", "b"), map(ids, g.split("|")))) for g in got.groups.decode().split(";")] if text and got else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "groups": pd.Series(groups, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def linked(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): links are packed codes of 32 bits, a * pieces + b."""
    paths = _paths(byte_path, piece_path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(*paths)
        for batch in batches:
            ids, at = batch["doc_id"].astype("Int64").array, 0
            for texts in _slices([t or "" for t in batch["text"]], SLICE_CHARS):
                out = [(g.n_a, g.n_b, len(g.links) // 4, hashlib.sha256(g.groups).hexdigest(), g.links) if t and g else (0, 0, 0, "", b"")
                       for t, g in zip(texts, pair.align_texts(texts))]
                out = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "groups_sha256", "links"])
                out.insert(0, "doc_id", ids[at:at + len(out)])
                at += len(out)
                yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        rows, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def counted(links: DataFrame) -> DataFrame:
    """(code, n): how often each pair is linked in all rows; a task merges its own before they are shuffled."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, waiting, size = np.zeros(0, "<u4"), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.zeros(0, "<u4"), *waiting]), return_counts=True)
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for packed in batch["links"]:
                waiting.append(np.frombuffer(packed, "<u4"))
                size += len(waiting[-1])
                if size > LINKS:
                    codes, counts = merged()
                    waiting, size = [], 0
                    if len(codes) > SLICE_PAIRS:
                        yield pd.DataFrame({"code": codes.astype(np.int64), "n": counts})
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        yield pd.DataFrame({"code": codes.astype(np.int64), "n": counts})

    return links.select("links").mapInPandas(sums, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def valued(rows: DataFrame, pairs: pd.DataFrame) -> DataFrame:
    """`rows` with the links of one slice of the pairs (code, n, best) added to n_best and count_sum."""
    pairs = pairs.sort_values("code")
    table = rows.sparkSession.sparkContext.broadcast(
        (pairs["code"].to_numpy(np.uint32), np.append(pairs["n"].to_numpy(np.int64), 0), np.append(pairs["best"].to_numpy(np.int64), 0)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, best = table.value
        for batch in batches:
            sums, bests = batch["count_sum"].to_numpy(np.int64).copy(), batch["n_best"].to_numpy(np.int64).copy()
            for k, packed in enumerate(batch["links"]):
                if packed:
                    link = np.frombuffer(packed, "<u4")
                    at = np.searchsorted(codes, link)
                    at[at == len(codes)] = len(codes) - 1
                    at[codes[at] != link] = len(codes)
                    sums[k] += counts[at].sum()
                    bests[k] += best[at].sum()
            yield batch.assign(count_sum=sums, n_best=bests, doc_id=batch["doc_id"].astype("Int64"))

    return rows.mapInPandas(add, rows.schema)


def alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs` (doc_id, text).

    A link is an A and a B token that end together; each group has one. Texts that are null or empty, or
    that either tokenizer spells with other bytes, have zeros and no digest. Repeated rows count
    as often as they stand and give repeated results; ties for a B id's highest count are all best. Very long texts are one row of
    their task, of about four bytes a link; other columns aren't read; an empty table gives no rows.

    One pass encodes and stores the links, one counts pairs (merged in each task, then one shuffle
    of pairs), one looks the counts up. The pairs are bounded by both vocabularies and come to the tasks in slices of at most
    `slice_pairs` (or those of one B id); more than one slice is more than one such pass, the rows written between.
    """
    width = load(*_paths(byte_path, piece_path)).width
    rows = stored(linked(docs, byte_path, piece_path))
    pairs = stored(counted(rows))
    pairs = pairs.withColumn("b", F.col("code") % width)
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"), F.count("*").alias("pairs"))
    sizes = highest.toPandas().sort_values("b")             # at most one row for each piece
    pairs = pairs.join(F.broadcast(highest.select("b", "highest")), "b").select("b", "code", "n", (F.col("n") == F.col("highest")).alias("best"))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    slices, total = [], slice_pairs
    for b, n in zip(sizes["b"].tolist(), sizes["pairs"].tolist()):
        if total + n > slice_pairs:
            slices.append([b, b])
            total = 0
        slices[-1][1] = b
        total += n
    for k, (low, high) in enumerate(slices):
        rows = valued(rows, pairs.where(F.col("b").between(low, high)).drop("b").toPandas())
        if k + 1 < len(slices):
            rows = stored(rows)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
