"""BPE encoding and decoding by speculation and verification.

Each distinct word is first cut by greedy longest match. A cut is the one that the merges give if and only if every
pair of adjacent tokens is compatible: undoing both tokens merge by merge, from the latest to the first, at no time do
the two symbols that touch at the border have a merge that comes before the ones that took them inside. All new pairs
of a batch are tested at once in numpy and verdicts are kept. Only words with a pair that fails go through the merges, and
so do words beyond LONG letters, whose proposal would save nothing: those by a queue, in n log n.

Null texts are empty texts and give no ids; words of any length and any characters are encoded whole. Rows are handled
one by one, so repeated rows and ids give repeated results, and an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Words, doc_text, held, ragged, slices

#: Distinct words that a worker keeps; the table is emptied beyond that.
CACHE_WORDS = 600_000
#: Below this code point no character combines with others, so NFC leaves texts as they are.
FIRST_COMBINING = "̀"
#: Pair verdicts that a worker keeps.
MAX_VERDICTS = 2_000_000
#: Letters of byte-level BPE are below it; PAD fills rows up.
LETTERS, PAD = 512, 511
#: Stands for the end-of-word mark as one character.
END = "\0"
#: White space as the library's patterns have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = "\x1f"
IRREGULAR = r"[ \n][ \n]|[ \n]\z|[\t\x0b\f\r\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NEVER = np.iinfo(np.int64).max
#: Longer words (in letters) go to the exact merges at once: their proposal would advance one letter at a time.
LONG = 512
#: The low bits of a queue entry, which hold a place.
PLACE = (1 << 40) - 1


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, others as U+0100, U+0101, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(odd)) for b in range(256)}


class Merges:
    """The vocabulary, its merges, and the compatibility of token pairs."""

    def __init__(self, model: dict):
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        n = max(vocab.values()) + 1
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.left[t], self.right[t], self.rank[t] = x, y, k
            self.ranks[x, y] = (k, t)
        self.size = n
        keys = np.fromiter((x * n + y for x, y in self.ranks), np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.fromiter((k for k, _ in self.ranks.values()), np.int64, len(keys))[order]
        self.key_token = np.fromiter((t for _, t in self.ranks.values()), np.int64, len(keys))[order]
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.base, self.base_end = np.full(LETTERS, -1), np.full(LETTERS, -1)
        for b, c in byte_letters().items():
            self.base[ord(c)], self.base_end[ord(c)] = vocab[c], vocab.get(c + self.suffix, -1)
        self._trie(vocab)
        self.known, self.fine = np.zeros(0, np.int64), np.zeros(0, bool)

    def _trie(self, vocab: dict[str, int]) -> None:
        """steps: sorted node * LETTERS + letter, the k-th of which leads to node k + 1; ends: the token of that node."""
        words = self._reachable(vocab)
        children: dict[int, dict[int, int]] = {0: {}}
        tokens: dict[int, int] = {}
        for text, i in words.items():
            node = 0
            for c in text:
                own = children[node]
                if ord(c) not in own:
                    own[ord(c)] = len(children)
                    children[len(children)] = {}
                node = own[ord(c)]
            tokens[node] = i
        steps, ends, queue, number = [], [], [0], 0
        for node in queue:  # breadth first, letters in order: the keys come out sorted
            for c, to in sorted(children[node].items()):
                steps.append(number * LETTERS + c)
                ends.append(tokens.get(to, -1))
                queue.append(to)
            number += 1
        self.steps, self.ends = np.array(steps), np.array(ends)

    def _reachable(self, vocab: dict[str, int]) -> dict[str, int]:
        """Tokens that the merges give for their own text."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(self.size, bool)
        fine[made] = self._compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            fine[t] &= fine[self.left[t]] and fine[self.right[t]]
        ending = {t: t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t for t in vocab}
        return {ending[t]: i for t, i in vocab.items() if fine[i]}

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border between a and b, before `until` where it is given."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        a_end = np.full(len(a), NEVER) if until is None else until.copy()
        b_end = a_end.copy()
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
            crossed = (rank < a_end) & (rank <= b_end) & (rank < NEVER)
            ok[live[crossed]] = False
            undo_a = self.rank[a] > self.rank[b]  # of two equal tokens the right one was made later
            go = ~crossed & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            a_end, b_end = np.where(undo_a, self.rank[a], a_end), np.where(undo_a, b_end, self.rank[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            live, a, b, a_end, b_end = live[go], a[go], b[go], a_end[go], b_end[go]
        return ok

    def propose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all rows at once, along the trie of tokens; a row that ends without a token fails.

        letters: a row for each word, padded with PAD. Returns tokens (padded with -1) and which rows failed.
        """
        n, width = letters.shape
        cuts = np.full((n, width), -1, np.int64)
        failed = np.zeros(n, bool)
        row = np.flatnonzero(letters[:, 0] != PAD)
        at, best, token, node, made = (np.zeros(len(row), np.int64) for _ in range(5))
        letters = np.concatenate([letters, np.full((n, 1), PAD, letters.dtype)], axis=1)
        while len(row):
            key = node * LETTERS + letters[row, at]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            found = self.steps[k] == key
            node = np.where(found, k + 1, 0)
            at = at + found
            ends = found & (self.ends[k] >= 0) & (letters[row, at] != 0)  # a token may not leave the end mark alone
            best, token = np.where(ends, at, best), np.where(ends, self.ends[k], token)
            stuck = ~found & (best == 0)
            failed[row[stuck]] = True
            take = ~found & ~stuck
            cuts[row[take], made[take]] = token[take]
            made = made + take
            at = np.where(take, best, at)
            best = np.where(take, 0, best)
            go = ~stuck & ~(take & (letters[row, at] == PAD))
            row, at, best, token, node, made = row[go], at[go], best[go], token[go], node[go], made[go]
        return cuts, failed

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no merge) and place among the merges of each pair."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_rank[at], NEVER), at

    def merge(self, letters: np.ndarray) -> np.ndarray:
        """The merges themselves on all rows at once: in each round the leftmost of the lowest rank of every row."""
        ids = np.where(letters == PAD, -1, self.base[letters])
        if self.suffix:  # the last letter and the end mark are one symbol
            last = (letters != PAD).sum(1) - 2
            r = np.arange(len(ids))
            ids[r, last] = self.base_end[letters[r, last]]
            ids[r, last + 1] = -1
        out = ids.copy()
        rank, _ = self._pair_rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        columns = np.arange(ids.shape[1])
        while len(live) and ids.shape[1] > 1:
            k = rank.argmin(1)
            r = np.arange(len(live))
            go = rank[r, k] < NEVER
            out[live[~go]] = ids[~go]
            live, ids, rank, k, r = live[go], ids[go], rank[go], k[go], r[: go.sum()]
            if not len(live):
                break
            _, at = self._pair_rank(ids[r, k], ids[r, k + 1])
            shifted = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1)], axis=1)
            ids = np.where(columns > k[:, None], shifted, ids)
            ids[r, k] = self.key_token[at]
            shifted = np.concatenate([rank[:, 1:], np.full((len(ids), 1), NEVER)], axis=1)
            rank = np.where(columns[:-1] > k[:, None], shifted, rank)
            for j in (k - 1, k):
                j = np.clip(j, 0, rank.shape[1] - 1)
                rank[r, j] = self._pair_rank(ids[r, j], ids[r, j + 1])[0]
        out[live] = ids
        return out

    def merge_long(self, form: str) -> np.ndarray:
        """The merges on one word of any length, the lowest rank first and of equal ones the leftmost, in n log n."""
        letters = np.frombuffer(form.encode("utf-16-le"), np.uint16)
        ids = self.base[letters]
        if self.suffix:
            ids = np.append(ids[:-2], self.base_end[letters[-2]])
        n = len(ids)
        rank, _ = self._pair_rank(ids[:-1], ids[1:])
        open_ = np.flatnonzero(rank < NEVER)
        queue = np.sort((rank[open_] << 40) + open_).tolist()  # sorted, so a heap
        own, before, after, pairs = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1], self.ranks
        while queue:
            entry = heapq.heappop(queue)
            at = entry & PLACE
            right = after[at]
            if own[at] < 0 or right < 0:
                continue
            found = pairs.get((own[at], own[right]))
            if found is None or found[0] != entry >> 40:
                continue  # what stood there has been merged since
            own[at], own[right] = found[1], -1
            after[at] = follows = after[right]
            if follows >= 0:
                before[follows] = at
                if new := pairs.get((own[at], own[follows])):
                    heapq.heappush(queue, (new[0] << 40) + at)
            if (left := before[at]) >= 0 and (new := pairs.get((own[left], own[at]))):
                heapq.heappush(queue, (new[0] << 40) + left)
        out = np.array(own, np.int64)
        return out[out >= 0]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole words, one after another, and their sizes: proposals where all adjacent pairs are compatible, merges elsewhere."""
        end = END if self.suffix else ""
        forms = [w.encode().decode("latin-1").translate(self.letters) + end for w in words]
        size = np.fromiter(map(len, forms), np.int64, len(forms))
        counts = np.zeros(len(forms), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = 0
        for k in np.flatnonzero(size > LONG).tolist():
            own = self.merge_long(forms[k])
            counts[k] = len(own)
            found.append((np.array([k]), own[None]))
        while top < min(LONG, size.max(initial=0)):  # words of like length share a matrix
            low, top = top, max(8, 2 * top)
            rows = np.flatnonzero((size > low) & (size <= top))
            step = max(1, 4_000_000 // top)
            for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                letters = np.frombuffer("".join(forms[k].ljust(top, chr(PAD)) for k in part.tolist()).encode("utf-16-le"), np.uint16).reshape(len(part), top).astype(np.int64)
                cuts, failed = self.propose(letters)
                failed |= ~self._fits(cuts)
                cuts[failed] = self.merge(letters[failed])
                counts[part] = (cuts >= 0).sum(1)
                found.append((part, cuts))
        starts = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), np.uint32)
        for part, cuts in found:
            own = cuts >= 0
            ids[(starts[part][:, None] + np.cumsum(own, 1) - 1)[own]] = cuts[own]
        return ids, counts

    def _fits(self, cuts: np.ndarray) -> np.ndarray:
        """Whether all adjacent pairs of each row are compatible; the verdicts of new pairs are kept."""
        a, b = cuts[:, :-1], cuts[:, 1:]
        both = (a >= 0) & (b >= 0)
        pair = a[both] * self.size + b[both]
        if len(self.known) > MAX_VERDICTS:
            self.known, self.fine = self.known[:0], self.fine[:0]
        new = np.unique(pair)
        new = new[~np.isin(new, self.known, assume_unique=True)]
        known = np.concatenate([self.known, new])
        fine = np.concatenate([self.fine, self._compatible(new // self.size, new % self.size)])
        order = np.argsort(known, kind="stable")
        self.known, self.fine = known[order], fine[order]
        ok = np.ones(both.shape, bool)
        if len(pair):
            ok[both] = self.fine[np.searchsorted(self.known, pair)]
        return ok.all(1)


class Encoder:
    """Texts to ids as the tokenizers library gives them, for the two kinds of file described in the README."""

    most_words = CACHE_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(spec["model"])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = bool(self.merges.suffix)
        # The patterns by which the two tokenizers cut texts into words.
        by_word = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^S\p{L}\p{N}]+"
        by_space = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+"
        self.mark = "\n" if self.by_word else CUT
        own = (by_word if self.by_word else by_space).replace("S\\", SPACE + "\\").replace("[S]", f"[{SPACE}]").replace("[^S]", f"[^{SPACE}]")
        self.pattern = regex.compile(own)
        self.marked = regex.compile(f"{self.mark}|" + (own if self.by_word else own.replace("\\p{L}\\p{N}]", f"\\p{{L}}\\p{{N}}{CUT}]")))
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self._empty()

    def _empty(self) -> None:
        self.row: dict[str | tuple, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0
        self._add([self.mark], self.ids[:0], np.zeros(1, np.int64))

    def _add(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.row.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)])
        self.used += len(ids)

    def _words(self, chunk: str) -> list:
        """The words of a piece of text. A piece with a special token is left to the library, as a tuple."""
        if "<|" in chunk and any(s in chunk for s in self.special):
            return [(chunk,)]
        if not self.by_word:
            return self.pattern.findall(chunk)
        if chunk.isascii() or max(chunk) < FIRST_COMBINING:
            return self.pattern.findall(chunk.lower())
        normal = self.library.normalizer.normalize_str(chunk)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the offsets by text."""
        if len(self.row) > self.most_words:
            self._empty()
        words = Words(texts) if self.by_word else pieces(texts)
        flat, ends = self._split(words.unique)
        new = set(flat).difference(self.row)
        for w in new:
            if isinstance(w, tuple):
                ids = np.array(self.library.encode(w[0], add_special_tokens=False).ids, np.uint32)
                self._add([w], ids, np.array([len(ids)]))
        new = [w for w in new if isinstance(w, str)]
        self._add(new, *self.merges.encode(new))
        rows = np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))
        ids, by_word = ragged(self.ids, self.starts, rows)
        if ends is None:
            ends = np.flatnonzero(rows == self.row[self.mark]) + 1
        by_chunk = by_word[np.concatenate([[0], ends]).astype(np.int64)]
        ids, by_chunk = ragged(ids, by_chunk, words.index)
        return ids, by_chunk[words.offsets]

    def _split(self, unique: list[str]) -> tuple[list, np.ndarray | None]:
        """The words of all pieces, and where each piece ends; None: at each mark, which is a word without ids."""
        text = self.mark.join(unique)
        if unique and "<|" not in text and text.count(self.mark) == len(unique) - 1 and (not self.by_word or max(text, default="") < FIRST_COMBINING):
            return [*self.marked.findall(text.lower() if self.by_word else text), self.mark], None
        flat: list = []
        sizes = []
        for chunk in unique:
            found = self._words(chunk)
            if self.mark in chunk:  # one in the text is left to the library
                found = [(w,) if w == self.mark else w for w in found]
            flat += found
            sizes.append(len(found))
        return flat, np.cumsum(sizes)

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives: a file without a decoder has its tokens joined by spaces."""
        if self.library.decoder is None:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


def pieces(texts: pa.Array) -> Words:
    """Texts cut before each space and line feed, where their words don't depend on what is before the cut.

    That holds where no white space meets other white space or the end; other texts are a piece each.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, IRREGULAR)
    cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", CUT + " "), "\n", CUT + "\n")
    words = Words(cut, CUT)
    for k, text in zip(np.flatnonzero(np.asarray(odd)).tolist(), texts.filter(odd).to_pylist(), strict=True):
        words.index[words.offsets[k]] = len(words.unique)
        words.unique.append(text)
    return words


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return held(path, lambda: Encoder(path))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(docs: DataFrame, name: str = "word_bpe_49k.json", keep: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (array of int), n_tokens, decoded, and the SHA-256 of both; keep=False: without ids and texts."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(name))
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.encode(part.column("text"))
                ids = ids.astype("<u4")
                own = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
                texts = [enc.decode(x) for x in own]
                cols = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
                if keep:
                    cols += [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return doc_text(docs).mapInArrow(run, schema)
