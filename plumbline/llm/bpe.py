"""BPE encoding and decoding: speculate with the greedy longest match, verify every adjacent pair, merge exactly only where a pair fails.

A sequence of tokens is the BPE encoding of a word exactly if each token is the encoding
of its own string and each adjacent pair is the encoding of the two strings joined. So the
codec proposes the longest vocabulary entries from the left (all words of a chunk walk the
vocabulary's trie together), checks the pairs of all words at once against the pairs already
known, decides unknown pairs by merging just the two strings, and hands only words with a
failing pair to the exact merger, which merges all of them together, one merge a word and step.

Distribution: map-only over Arrow batches. A text is split at white space; the tokens of
a piece depend on that piece alone, so the different pieces of a chunk of whole texts
(CHUNK_BYTES, one text at least) are encoded once and gathered by offsets. Nothing but the
vocabulary and the verdicts on pairs (PAIRS at most) outlives a chunk. Texts are never cut.

Defined results: null and empty texts have no tokens and decode to the empty text;
decoding an id that the vocabulary lacks adds nothing, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.common import give_back, released

#: Bytes of texts that are encoded at once.
CHUNK_BYTES = 1_000_000
#: Verdicts on pairs that are kept between chunks.
PAIRS = 500_000
#: Words of more symbols than this are proposed and merged one by one, over a heap.
LONG = 96
_NONE = 1 << 40
#: The file's pre-tokenizer pattern on lower-case ASCII without white space but for line feeds between pieces.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n").findall
#: White space of Arrow that the tokenizer's own pattern does not take for white space.
_ODD_SPACE = "[\x1c-\x1f]"
#: Letters of the trie: the bytes' stand-ins are below 512, the word's end is the last.
_LETTERS, _END = 512, 511


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Codec:
    """Encodes and decodes with one tokenizer file (BPE with word ends, lower case, white space dropped)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {v: k for k, v in (self.vocab | self.special).items()}
        self.size = max(self.token_of) + 1
        #: The tokens' strings by id.
        self.strings = pa.array([self.token_of.get(k, "") for k in range(self.size)], pa.large_string())
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in map(tuple, model["merges"])]
        left, right, self.merged_id = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        codes = left * self.size + right
        order = np.argsort(codes, kind="stable")
        #: Sorted codes (left x size + right) of the merges, and their ranks; equal codes: the last rank counts, as in the library's map.
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        last = np.r_[self.codes[1:] != self.codes[:-1], True]
        self.codes, self.ranks = self.codes[last], self.ranks[last]
        #: left x size + right -> rank, for long words.
        self.rank_of = dict(zip(self.codes.tolist(), self.ranks.tolist(), strict=True))
        self._symbols()
        self._trie()
        library = Tokenizer.from_file(path)
        self.normalize, self.pretokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)))
        self.has_special = "<|"
        self.is_space = regex.compile(r"\s+").split
        #: Whether a token is the encoding of its own string: 0 not asked yet, 1 yes, 2 no.
        self.own = np.zeros(self.size, np.int8)
        self.known, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Words that failed a pair and were merged exactly, for tests and figures.
        self.merged = 0

    def _symbols(self) -> None:
        """The ids of single characters inside a word and at its end, and every token as symbols."""
        self.inner, self.last = np.full(_LETTERS, -1, np.int64), np.full(_LETTERS, -1, np.int64)
        for t, k in self.vocab.items():
            if len(t) == 1:
                self.inner[ord(t)] = k
            elif len(t) == 1 + len(self.end) and t.endswith(self.end):
                self.last[ord(t[0])] = k
        sizes, flat = np.zeros(self.size, np.int64), []
        for k in range(self.size):
            t = self.token_of.get(k, "") if k in self.token_of and self.token_of[k] in self.vocab else ""
            found = self.symbols(t.removesuffix(self.end), t.endswith(self.end)) if t else []
            sizes[k] = len(found)
            flat += found
        self.symbol_size, self.symbol_start, self.symbol_flat = sizes, starts_of(sizes), np.array(flat, np.int64)

    def _trie(self) -> None:
        """The vocabulary as a trie in sorted arrays: node x letters + letter -> node, and the token that a node completes."""
        step: dict[int, int] = {}
        accept = [-1]
        for t, k in self.vocab.items():
            node = 0
            letters = [*map(ord, t.removesuffix(self.end)), _END] if t.endswith(self.end) else list(map(ord, t))
            for c in letters:
                key = node * _LETTERS + c
                node = step.get(key, -1)
                if node < 0:
                    node = step[key] = len(accept)
                    accept.append(-1)
            accept[node] = k
        self.step = step
        keys = np.fromiter(step, np.int64, len(step))
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes, self.accept = keys[order], np.fromiter(step.values(), np.int64, len(step))[order], np.array(accept, np.int64)

    # exact merging

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of these pairs; _NONE where there is none."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], _NONE)

    def merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BPE merges of many words (symbols one after the other, sizes of at least 1), lowest rank first and leftmost first; one merge a word and step."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        rank = np.full(len(ids), _NONE)
        inside = owner[1:] == owner[:-1]
        rank[:-1][inside] = self.rank(ids[:-1][inside], ids[1:][inside])
        done_owner, done_ids = [], []
        ids = ids.copy()
        while len(ids):
            first = np.r_[True, owner[1:] != owner[:-1]]
            low = np.minimum.reduceat(rank, np.flatnonzero(first))
            word = np.cumsum(first) - 1
            over = low == _NONE
            if over.any():
                rest = ~over[word]
                done_owner.append(owner[~rest])
                done_ids.append(ids[~rest])
                ids, owner, rank, low = ids[rest], owner[rest], rank[rest], low[~over]
                if not len(ids):
                    break
                word = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1
            hit = np.flatnonzero(rank == low[word])
            at = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
            ids[at] = self.merged_id[low]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            rank[at] = _NONE
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))
            for left in (at[(at > 0)] - 1, at[at + 1 < len(ids)]):
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self.rank(ids[left], ids[left + 1])
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        owner, flat = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=n)

    def merge(self, ids: list[int]) -> list[int]:
        """The same for one word, over a linked list with a heap: n log n."""
        n, get, size = len(ids), self.rank_of.get, self.size
        after, before, live = list(range(1, n)) + [-1], list(range(-1, n - 1)), list(ids)
        heap = [(m, i, live[i], live[i + 1]) for i in range(n - 1) if (m := get(live[i] * size + live[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = int(self.merged_id[m]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            p, q = before[i], after[i]
            if p >= 0 and (m := get(live[p] * size + live[i])) is not None:
                heapq.heappush(heap, (m, p, live[p], live[i]))
            if q >= 0 and (m := get(live[i] * size + live[q])) is not None:
                heapq.heappush(heap, (m, i, live[i], live[q]))
        return [x for x in live if x >= 0]

    def symbols(self, word: str, ended: bool = True) -> list[int]:
        """The ids of the single characters, the last with the word's end."""
        get = self.vocab.__getitem__
        return [*map(get, word[:-1]), get(word[-1] + self.end)] if ended else [*map(get, word)]

    # speculation and verification

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of one word; the last token is the one with the word's end."""
        letters, out, i, step, accept = [*map(ord, word), _END], [], 0, self.step.get, self.accept
        n = len(word)
        while i <= n:
            node, best, to = 0, -1, i
            for j in range(i, n + 1):
                node = step(node * _LETTERS + letters[j], -1)
                if node < 0:
                    break
                if accept[node] >= 0 and j != n - 1:
                    best, to = int(accept[node]), j + 1
            if best < 0:
                raise ValueError(f"no token for {word[i:]!r}")
            out.append(best)
            i = to
        return out

    def propose_all(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words, whose letters (each word closed by the end) walk the trie together: tokens one after the other, and their numbers."""
        n, stop = len(sizes), np.cumsum(sizes)
        word, at = np.arange(n), starts_of(sizes)
        node, best, to = np.zeros(n, np.int64), np.full(n, -1), at.copy()
        out_word, out_token = [], []
        while len(word):
            key = node * _LETTERS + letters[np.minimum(at, len(letters) - 1)]
            k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            alive = (at < stop[word]) & (self.trie_keys[k] == key)
            node = np.where(alive, self.trie_nodes[k], 0)
            at = at + alive
            # the last character may be taken with the word's end only
            taken = alive & (self.accept[node] >= 0) & (at != stop[word] - 1)
            best, to = np.where(taken, self.accept[node], best), np.where(taken, at, to)
            dead = ~alive
            if dead.any():
                if (best[dead] < 0).any():
                    raise ValueError("no token for a character")
                out_word.append(word[dead])
                out_token.append(best[dead])
                at = np.where(dead, to, at)
                best = np.where(dead, -1, best)
                rest = ~(dead & (at >= stop[word]))
                word, at, node, best, to = word[rest], at[rest], node[rest], best[rest], to[rest]
        owner, tokens = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=n)

    def of_tokens(self, tokens: np.ndarray) -> np.ndarray:
        """The symbols of tokens, one token after the other."""
        return self.symbol_flat[places(self.symbol_start[tokens], self.symbol_size[tokens])]

    def judge_tokens(self, tokens: np.ndarray) -> None:
        """Decides of each token whether it is the encoding of its own string."""
        ask = tokens[self.own[tokens] == 0]
        if len(ask):
            flat, sizes = self.merge_all(self.of_tokens(ask), self.symbol_size[ask])
            self.own[ask] = np.where((sizes == 1) & (flat[np.minimum(starts_of(sizes), len(flat) - 1)] == ask), 1, 2)

    def judge_pairs(self, codes: np.ndarray) -> np.ndarray:
        """For sorted different codes (left x size + right) whether the pair is the encoding of its joined strings."""
        out = np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        held = self.known[at] == codes if len(self.known) else out.copy()
        out[held] = self.verdicts[at[held]] if len(self.known) else False
        new = codes[~held]
        if len(new):
            left, right = new // self.size, new % self.size
            both = np.column_stack([left, right]).ravel()
            flat, sizes = self.merge_all(self.of_tokens(both), self.symbol_size[left] + self.symbol_size[right])
            first = starts_of(sizes)
            fine = (sizes == 2) & (flat[first] == left) & (flat[np.minimum(first + 1, len(flat) - 1)] == right)
            out[~held] = fine
            if len(self.known) + len(new) > PAIRS:
                self.known, self.verdicts = new[:PAIRS], fine[:PAIRS]
            else:
                known = np.concatenate([self.known, new])
                order = np.argsort(known)
                self.known, self.verdicts = known[order], np.concatenate([self.verdicts, fine])[order]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words (in stand-in characters) one after the other, and their numbers: propose all, check all pairs at once, merge the failing words."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
        start = starts_of(sizes)
        short = sizes <= LONG
        few = np.flatnonzero(short)
        proposals: list[np.ndarray] = [np.zeros(0, np.int64)]
        owners: list[np.ndarray] = [np.zeros(0, np.int64)]
        if len(few):
            closed = np.full(int((sizes[few] + 1).sum()), _END, np.int64)
            closed[places(starts_of(sizes[few] + 1), sizes[few])] = letters[places(start[few], sizes[few])]
            tokens, numbers = self.propose_all(closed, sizes[few] + 1)
            proposals.append(tokens)
            owners.append(np.repeat(few, numbers))
        for k in np.flatnonzero(~short):
            found = self.propose(words[k])
            proposals.append(np.array(found, np.int64))
            owners.append(np.full(len(found), k))
        flat, owner = np.concatenate(proposals), np.concatenate(owners)

        inside = owner[1:] == owner[:-1]
        codes, pair_owner = (flat[:-1] * self.size + flat[1:])[inside], owner[1:][inside]
        different, back = np.unique(codes, return_inverse=True)
        self.judge_tokens(np.unique(flat))
        failing = np.zeros(len(words), bool)
        failing[pair_owner[~self.judge_pairs(different)[back]]] = True
        failing[owner[self.own[flat] == 2]] = True
        self.merged += int(failing.sum())

        keep = ~failing[owner]
        parts, part_owner = [flat[keep]], [owner[keep]]
        redo = np.flatnonzero(failing & short)
        if len(redo):
            symbols = self.inner[letters[places(start[redo], sizes[redo])]]
            ends = np.cumsum(sizes[redo]) - 1
            symbols[ends] = self.last[letters[start[redo] + sizes[redo] - 1]]
            ids, numbers = self.merge_all(symbols, sizes[redo])
            parts.append(ids)
            part_owner.append(np.repeat(redo, numbers))
        for k in np.flatnonzero(failing & ~short):
            ids = self.merge(self.symbols(words[k]))
            parts.append(np.array(ids, np.int64))
            part_owner.append(np.full(len(ids), k))
        flat, owner = np.concatenate(parts), np.concatenate(part_owner)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    # pieces and texts

    def words_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of pieces in the bytes' stand-ins, and each one's piece, by the file's own normalizer and pre-tokenizer; pieces hold no white space, so all go through them in one string."""
        joined = self.normalize(" ".join(pieces))
        normal = joined.split(" ")
        if len(normal) != len(pieces):
            each = [[w for w, _ in self.pretokenize(self.normalize(p))] for p in pieces]
            return [w for ws in each for w in ws], np.repeat(np.arange(len(pieces)), list(map(len, each)))
        begin = starts_of(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
        found = self.pretokenize(joined)
        return [w for w, _ in found], np.searchsorted(begin, np.array([s for _, (s, _) in found], np.int64), "right") - 1

    def strange_words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The same for pieces that may hold special tokens, which stand for themselves (behind a null character)."""
        if not any(self.has_special in p for p in pieces):
            return self.words_of(pieces)
        # pieces are cut at special tokens, the parts between go through the normalizer
        parts: list[str] = []
        part_of: list[tuple[int, int]] = []
        words, keys = [], []
        for k, p in enumerate(pieces):
            at = 0
            for m in [*self.split_special.finditer(p), None]:
                stop = m.start() if m else len(p)
                if stop > at:
                    parts.append(p[at:stop])
                    part_of.append((k, at))
                if m:
                    words.append("\0" + m[0])
                    keys.append((k, m.start()))
                    at = m.end()
        if parts:
            found, owner = self.words_of(parts)
            words += found
            keys += [part_of[k] for k in owner.tolist()]
        place = np.array(keys, np.int64).reshape(-1, 2)
        order = np.lexsort((place[:, 1], place[:, 0]))
        return [words[k] for k in order.tolist()], place[order, 0]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces one after the other, and their numbers."""
        n = len(pieces)
        ascii_ = pc.string_is_ascii(pieces)
        letters = pc.and_(ascii_, pc.ascii_is_alpha(pieces)).to_numpy(zero_copy_only=False)
        plain = pc.and_not(pc.and_(ascii_, pc.ascii_is_printable(pieces)), pc.match_substring(pieces, self.has_special)).to_numpy(zero_copy_only=False) & ~letters
        full = pc.binary_length(pieces).to_numpy(zero_copy_only=False) > 0
        one, some, rest = np.flatnonzero(letters), np.flatnonzero(plain & full), np.flatnonzero(~letters & ~plain & full)
        words, owner = [pc.ascii_lower(pieces.take(pa.array(one)))], [one]
        if len(some):
            # all in one string, whose line feeds part the pieces
            found = pa.array(_ASCII_WORDS("\n".join(pieces.take(pa.array(some)).to_numpy(zero_copy_only=False)).lower()), pa.large_string())
            part = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
            words.append(found.filter(pa.array(~part)))
            owner.append(some[np.cumsum(part)[~part]])
        if len(rest):
            found, at = self.strange_words(list(pieces.take(pa.array(rest)).to_numpy(zero_copy_only=False)))
            words.append(pa.array(found, pa.large_string()))
            owner.append(rest[at])
        coded = pa.concat_arrays(words).dictionary_encode()
        names = list(coded.dictionary.to_numpy(zero_copy_only=False))
        order = np.argsort(np.concatenate(owner), kind="stable")
        word, owner = coded.indices.to_numpy(zero_copy_only=False)[order], np.concatenate(owner)[order]

        special = np.fromiter((w[0] == "\0" for w in names), bool, len(names))
        ids, sizes = self.encode_words([w for w in names if w[0] != "\0"] if special.any() else names)
        if special.any():
            whole = np.ones(len(names), np.int64)
            whole[~special] = sizes
            spread = np.empty(int(whole.sum()), np.int64)
            begin = starts_of(whole)
            spread[places(begin[~special], sizes)] = ids
            spread[begin[special]] = [self.special[w[1:]] for w in names if w[0] == "\0"]
            ids, sizes = spread, whole
        lengths = sizes[word]
        return ids[places(starts_of(sizes)[word], lengths)], np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)

    def encode_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after the other, and their numbers."""
        if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
            split = [self.is_space(t) for t in texts.to_pylist()]
            numbers = np.fromiter(map(len, split), np.int64, len(split))
            flat = pa.array([p for s in split for p in s], pa.large_string())
        else:
            lists = pc.utf8_split_whitespace(texts)
            numbers = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
        coded = flat.dictionary_encode()
        piece = coded.indices.to_numpy(zero_copy_only=False)
        ids, sizes = self.encode_pieces(coded.dictionary)
        lengths = sizes[piece]
        upto = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(numbers)
        return ids[places(starts_of(sizes)[piece], lengths)], upto[ends] - upto[ends - numbers]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Ranges of texts that come to CHUNK_BYTES together, one text at least."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + CHUNK_BYTES, "right")))
            yield at, end
            at = end

    def run(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
        """Chunk by chunk: first text, text after the last, ids, offsets of each text's ids, decoded texts."""
        for at, end in self.chunks(texts):
            # a chunk's texts only: a batch holds the whole texts of thousands of rows
            ids, sizes = self.encode_chunk(pc.fill_null(texts.slice(at, end - at).cast(pa.large_string()), ""))
            offsets = np.r_[0, np.cumsum(sizes)]
            yield at, end, ids.astype("<u4"), offsets, self.decode_all(ids, offsets)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each whole text its ids as little-endian unsigned 32-bit integers, and their decoded text in UTF-8."""
        out = []
        for _, _, ids, offsets, decoded in self.run(pa.array(texts, pa.large_string())):
            raw, width = ids.tobytes(), ids.itemsize
            out += [(raw[a * width : b * width], d.encode()) for a, b, d in zip(offsets[:-1], offsets[1:], decoded.to_pylist(), strict=True)]
        return out

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The tokens of each text joined by spaces, as the file (which names no decoder) asks for; special tokens stay."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.strings.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def decode(self, ids: Iterable[int]) -> str:
        """The same for one sequence of any ids."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
        # reading the file takes several times what the codec keeps
        give_back()
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int> and decoded text of every row of docs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at, end, ids, offsets, decoded in c.run(batch.column(1)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(at, end - at),
                        "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4"))),
                        "decoded": decoded.cast(pa.string()),
                    }
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same encoding and decoding, carried as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at, end, ids, offsets, decoded in c.run(batch.column(1)):
                raw, width = memoryview(ids.tobytes()), ids.itemsize
                text, bounds = memoryview(decoded.buffers()[2] or b""), np.frombuffer(decoded.buffers()[1], np.int64)[decoded.offset : decoded.offset + len(decoded) + 1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(at, end - at),
                        "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                        "ids_sha256": pa.array([sha(raw[a * width : b * width]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                        "decoded_sha256": pa.array([sha(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                    }
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
