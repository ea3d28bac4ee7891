"""BPE encoding and decoding: a bounded-lookahead streaming transducer.

Encoding reads a word symbol by symbol. Every prefix of a word has its own encoding, and all of it but its last token is
the encoding of a shorter prefix; so for each position only the last token is kept, found as the one token ending there
that may follow the last token of the prefix before it. Two tokens may follow each other if no merge that ranks before the
merges that formed them would have joined symbols across their border. A token is stable once every position from which a
token can still start leads back to it; how many symbols that takes at most is computed from the merge list
(`lookahead`), and not many more positions than that are ever kept.

Decoding is a state machine that is fed ids and gives text as soon as its bytes are complete characters.

The text around the merges follows the tokenizer file: NFC, lower case (character by character), pieces by its pattern,
bytes as printable characters, a suffix at the end of each word, its special tokens taken out first. Python does this for
the one normalizer and pattern that it knows; other ones, and characters on which its Unicode tables and the library's
differ, are left to the library's normalizer and pre-tokenizer, piece of text by piece of text.

Cases: a null or empty text has no tokens and decodes to the empty text; words of any length take constant memory; rows
with equal doc_id or text are encoded each by itself; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import codecs
import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm._shared import small_batches

RESULT = "doc_id long, n_tokens long, ids array<int>, decoded string"
ENCODED = "doc_id long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 has a visible one, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {b: chr(b) for b in own}
    out.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in out))
    return [out[b] for b in range(256)]


_SYMBOLS = byte_symbols()
_BYTES = {s: b for b, s in enumerate(_SYMBOLS)}
_TABLE = dict(enumerate(_SYMBOLS))


class Merges:
    """A merge list: what each token was joined from, and which tokens may follow each other."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], most: int = 400_000):
        self.most = most
        self.vocab, self.rank, self.parts, self.joins = vocab, {}, {}, {}
        for r, (a, b) in enumerate(merges):
            joined = vocab[a + b]
            if joined in self.rank:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[joined], self.parts[joined], self.joins[vocab[a], vocab[b]] = r, (vocab[a], vocab[b]), r
        self._follow: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        known = self._follow.get((a, b))
        if known is None:
            if len(self._follow) > self.most:
                self._follow.clear()
            known = self._follow[a, b] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        """Undoes the latest of the merges at the border again and again; a merge across it that ranks before the one
        undone would have come first. Of equal ranks the left one comes first."""
        before = len(self.joins)
        while True:
            if self.joins.get((a, b), before) < before:
                return False
            x, y = self.rank.get(a, -1), self.rank.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                before, a = x, self.parts[a][1]
            else:
                before, b = y + 1, self.parts[b][0]

    def lookahead(self, names: dict[int, str]) -> int:
        """Symbols after a token's end that settle it. A later symbol undoes the last token u only by a merge across its
        end, (x, y) with x a suffix of u, that ranks before u; what is left of u undoes the token before it only by a
        merge (x', y') with y' a prefix of u that ranks after (x, y), for an earlier one would have happened anyway; and
        so on with growing ranks. The longest such chain of merges, found from the last rank to the first, times the
        longest token bounds how far back a change can reach."""
        of = {s: i for i, s in names.items()}
        begins: dict[int, list[int]] = {}
        for t in self.rank:
            for k in range(1, len(names[t])):
                if names[t][:k] in of:
                    begins.setdefault(of[names[t][:k]], []).append(t)
        inside, reach, longest = {}, {}, 0
        done: set[int] = set()  # the tokens that rank after the merge now looked at

        def spread(t: int, chain: int) -> None:
            for k in range(1, len(names[t])):
                x = of.get(names[t][-k:])
                if x is not None and reach.get(x, 0) < chain:
                    reach[x] = chain

        for t, r in sorted(self.rank.items(), key=lambda x: -x[1]):
            a, b = self.parts[t]
            chain = 1 + reach.get(a, 0)
            longest = max(longest, chain)
            if chain > inside.get(b, 0):
                inside[b] = chain
                for u in begins.get(b, []):
                    if u in done:
                        spread(u, chain)
            done.add(t)
            spread(t, max((inside.get(of.get(names[t][:k], -1), 0) for k in range(1, len(names[t]))), default=0))
        return (longest + 1) * max(map(len, names.values()))


class Transducer:
    """Encodes a stream of symbols, the last of which carries the end-of-word suffix."""

    def __init__(self, merges: Merges, suffix: str, lookahead: int | None = None, most: int = 200_000):
        self.merges, self.suffix = merges, suffix
        self.inner = {s: i for s, i in merges.vocab.items() if i in merges.rank or len(s) == 1}
        self.final = {s[: len(s) - len(suffix)]: i for s, i in self.inner_and_base().items() if s.endswith(suffix)} if suffix else self.inner
        if suffix:
            self.inner = {s: i for s, i in self.inner.items() if not s.endswith(suffix)}
        self.size = {i: len(s) for d in (self.inner, self.final) for s, i in d.items()}
        self.widest = max(self.size.values())
        self.given = lookahead
        self.begun = Recent(most)  # the last tokens of all prefixes of what a word begins with
        self.ends = {id(d): self._ends(d) for d in (self.inner, self.final)}

    @staticmethod
    def _ends(known: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """For the last three symbols of a text, the lengths of the tokens that end so, longest first."""
        out: dict[str, set[int]] = {}
        for s in known:
            if len(s) > 2:
                out.setdefault(s[-3:], set()).add(len(s))
        return {s: tuple(sorted(n, reverse=True)) for s, n in out.items()}

    def lookahead(self) -> int:
        """Symbols that a token waits for at most. Takes some seconds; a driver computes it once for all tasks."""
        end = self.suffix and "\0"  # one character, so that it is no prefix or suffix of anything else
        names = {i: s for s, i in self.inner.items()} | {i: s + end for s, i in self.final.items()}
        return max(self.merges.lookahead(names), 2 * self.widest)

    def inner_and_base(self) -> dict[str, int]:
        base = {s: i for s, i in self.merges.vocab.items() if i not in self.merges.rank and len(s) == 1 + len(self.suffix)}
        return self.inner | base

    def _last(self, text: str, end: int, tokens: list[int], known: dict[str, int]) -> int:
        """The last token of the prefix text[:end]; tokens: the last tokens of the prefixes before it, from one symbol on
        that a token can begin after."""
        follow, get = self.merges.may_follow, known.get
        if end > 2:
            for k in self.ends[id(known)].get(text[end - 3 : end], ()):
                if k <= end:
                    token = get(text[end - k : end])
                    if token is not None and (tokens[-k] < 0 or follow(tokens[-k], token)):
                        return token
        for k in (2, 1) if end > 1 else (1,):
            token = get(text[end - k : end])
            if token is not None and (tokens[-k] < 0 or follow(tokens[-k], token)):
                return token
        raise ValueError(f"no token for {text[end - 1]!r}")

    def encode(self, symbols: str) -> Iterable[int]:
        """Token ids. A word that no token of would be given out before its end is read at once."""
        return self.word(symbols) if len(symbols) <= 8 * self.widest else self.stream(symbols)

    def word(self, text: str) -> list[int]:
        token = self.final.get(text)  # a token that spans the word follows nothing
        if token is not None:
            return [token]
        n, begun = len(text), self.begun
        tokens = next((list(t) for k in (8, 4) if k < n and (t := begun.get(text[:k]))), [-1])
        for end in range(len(tokens), n):
            tokens.append(self._last(text, end, tokens, self.inner))
            if end == 4 or end == 8:
                begun.put(text[:end], tuple(tokens))
        tokens.append(self._last(text, n, tokens, self.final))
        return self._back(tokens, n)

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids, each given out once it is stable; what is kept does not grow with the word."""
        window, tokens = "", [-1]  # tokens[k]: the last token of the prefix of k symbols; -1 at the start
        stream, look = iter(symbols), 8 * self.widest
        now = next(stream, None)
        while now is not None:
            after = next(stream, None)
            window += now
            tokens.append(self._last(window, len(window), tokens, self.final if after is None else self.inner))
            now = after
            if len(tokens) > look and now is not None:
                at = self._stable(tokens)
                yield from self._back(tokens, at)
                window, tokens = window[at:], tokens[at:]
                if self.given is not None and len(tokens) > self.given + 9 * self.widest:
                    raise AssertionError("a token took longer to settle than the merge list allows")
                look = len(tokens) + 8 * self.widest
        yield from self._back(tokens, len(tokens) - 1)

    def _stable(self, tokens: list[int]) -> int:
        """The last prefix that all prefixes from which a token can still start lead back to."""
        live = set(range(len(tokens) - self.widest, len(tokens)))
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(k - self.size[tokens[k]])
        return live.pop()

    def _back(self, tokens: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(tokens[at])
            at -= self.size[tokens[at]]
        return out[::-1]


class Table:
    """Whole numbers below 2**63 and what they stand for (from 0 on), asked for many at once."""

    def __init__(self, known: dict[int, int]):
        keys = np.fromiter(known, np.uint64, len(known))
        bits = max(4, len(known).bit_length() + 1)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _FREE), np.full(1 << bits, -1, np.int32)
        values = np.fromiter(known.values(), np.int32, len(known))
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] == _FREE
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = self.keys[at] != keys  # another one came into the same place
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.last

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for what is not known."""
        at = self._at(keys)
        found, out = self.keys[at], self.values[at]
        open_ = np.flatnonzero(found != keys)
        out[open_] = -1
        open_ = open_[found[open_] != _FREE]
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.last
            found = self.keys[at]
            here = found == keys[open_]
            out[open_[here]] = self.values[at[here]]
            more = ~here & (found != _FREE)
            open_, at = open_[more], at[more]
        return out


_FREE, _SPREAD = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)


class Together:
    """The transducer over many words at once: the same last tokens of the same prefixes, one position of all words after the
    other. All tokens inside all words are found on a trie before, level by level; whether one may follow another is asked
    for all words' tokens that end at a position together, and kept for the pairs met last."""

    longest = 64

    def __init__(self, transducer: Transducer, kept: int = 18):
        merges = transducer.merges
        top = max(merges.vocab.values()) + 1
        children: dict[int, int] = {}
        tokens: list[tuple[dict[int, int], dict[str, int]]] = [({}, transducer.inner), ({}, transducer.final)]
        for at, known in tokens:
            for name, token in known.items():
                if all(c in _BYTES for c in name):
                    node = 0
                    for c in name:
                        node = children.setdefault(node << 8 | _BYTES[c], len(children) + 1)
                    at[node] = token
        self.child, self.nodes = Table(children), len(children) + 1
        self.inner, self.final = (self._dense(at, self.nodes) for at, _ in tokens)
        self.first = self.child.get(np.arange(256, dtype=np.uint64))
        self.size = self._dense(transducer.size, top)
        self.rank = self._dense(merges.rank, top)
        self.left, self.right = (self._dense({t: p[k] for t, p in merges.parts.items()}, top) for k in (0, 1))
        self.joins, self.n_joins = Table({a << 32 | b: r for (a, b), r in merges.joins.items()}), len(merges.joins)
        self.pairs, self.answers = np.full(1 << kept, _FREE), np.zeros(1 << kept, bool)
        self.kept = np.uint64(64 - kept)

    @staticmethod
    def _dense(known: dict[int, int], n: int) -> np.ndarray:
        out = np.full(n, -1, np.int32)
        out[np.fromiter(known, np.int64, len(known))] = np.fromiter(known.values(), np.int32, len(known))
        return out

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges.may_follow for pairs of tokens."""
        pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = ((pair * _SPREAD) >> self.kept).astype(np.int64)
        out = self.answers[at]
        new = np.flatnonzero(self.pairs[at] != pair)
        if len(new):
            one, of = np.unique(pair[new], return_inverse=True)
            said = self._border((one >> np.uint64(32)).astype(np.int64), (one & np.uint64(2**32 - 1)).astype(np.int64))
            out[new] = said[of]
            place = ((one * _SPREAD) >> self.kept).astype(np.int64)
            place, k = np.unique(place, return_index=True)  # one pair a place
            self.pairs[place], self.answers[place] = one[k], said[k]
        return out

    def _border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges._border for pairs of tokens."""
        out, here, before = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), self.n_joins)
        while len(here):
            r = self.joins.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            x, y = self.rank[a], self.rank[b]
            apart = (r < 0) | (r >= before)
            out[here[apart & (x < 0) & (y < 0)]] = True
            go = apart & ((x >= 0) | (y >= 0))
            here, a, b, x, y = here[go], a[go], b[go], x[go], y[go]
            late = x > y
            before = np.where(late, x, y + 1)
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and where each word's begin and end. Word k is data[start[k]:start[k + 1]],
        of one byte at least and `longest` at most."""
        ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for k in range(0, len(start) - 1, step):
            some = start[k : k + step + 1]
            got, end = self._some(data[some[0] : some[-1]], some - some[0])
            ids.append(got)
            ends.append(end[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def _some(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(start) - 1, np.diff(start)
        word = np.repeat(np.arange(n), size)
        stop = start[1:][word]
        # place of a prefix: its last byte's number, with one more place before each word for the empty prefix
        last = np.full(len(data) + n, -2, np.int32)
        last[start[:-1] + np.arange(n)] = -1
        at, node, k = np.arange(len(data)), self.first[data], 1
        found = []
        while len(at):
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive]
            end = at + k
            over = end == stop[at]
            token = np.where(over, self.final[node], self.inner[node])
            is_token = np.flatnonzero(token >= 0)
            some, w = at[is_token], word[at[is_token]]
            found.append((some + k - start[w], some + w, some + w + k, token[is_token]))
            go = np.flatnonzero(~over)
            at, node = at[go], node[go]
            node = self.child.get(node.astype(np.uint64) << np.uint64(8) | data[at + k].astype(np.uint64))
            k += 1
        position, begin, end, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(position.astype(np.uint8), kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cuts = np.cumsum(np.bincount(position, minlength=1))
        for a, b in itertools.pairwise(cuts.tolist()):
            before = last[begin[a:b]]
            fits = before < 0
            inside = np.flatnonzero(~fits)
            fits[inside] = self._follow(before[inside], token[a:b][inside])
            last[end[a:b][fits]] = token[a:b][fits]
        if n and last.min() < -1:
            raise ValueError("no token for a byte")
        return self._back(last, start[1:] + np.arange(n))

    def _back(self, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of whole words, from their last ones on; at: the words' ends."""
        word, steps, count = np.arange(len(at)), [], np.zeros(len(at), np.int64)
        while len(word):
            token = last[at]
            go = token >= 0
            word, token, at = word[go], token[go], at[go]
            count[word] += 1
            steps.append((word, token))
            at = at - self.size[token]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(ends[-1], np.int32)
        for k, (word, token) in enumerate(steps):
            out[ends[word + 1] - 1 - k] = token
        return out, ends


class Decoder:
    """ids in, text out; bytes of a character that is not complete yet wait."""

    def __init__(self, names: dict[int, str], suffix: str | None = None):
        """suffix None: the tokens' names with one space between them, as a tokenizer without decoder gives them.
        Else the bytes that the names stand for, each suffix as a space."""
        self.names, self.suffix = names, suffix
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: Iterable[int]) -> str:
        names, suffix = [self.names[i] for i in ids], self.suffix
        if not names:
            return ""
        if suffix is None:
            data = ("" if self.first else " ").encode() + " ".join(names).encode()
        else:
            cut = len(suffix)
            data = b"".join([bytes([_BYTES[c] for c in n[:-cut]]) + b" " if n.endswith(suffix) else bytes([_BYTES[c] for c in n]) for n in names])
        self.first = False
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


class Recent:
    """What was computed last: two generations of up to `most` keys. What is used again moves to the younger one."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def get(self, key):
        value = self.now.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.now) >= self.most:
            self.now, self.old = {}, self.now
        self.now[key] = value


#: What WordBpe does itself before the merges; a file that asks for something else is read by the library.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends", encoded by the transducer.

    Raises ValueError for a file whose model has what the transducer does not know. odd: characters whose normal form or
    class differs between this Python and the tokenizers library (see odd_characters); pieces of text with one are cut by
    the library's own normalizer and pre-tokenizer.
    """

    def __init__(self, path: str, lookahead: int | None = None, most: int = 250_000, odd: str = ""):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        extra = {k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or extra or j["decoder"] is not None or j["post_processor"] is not None:
            raise ValueError(f"not a tokenizer file that this transducer can follow: {model['type']} {sorted(extra)}")
        if any(x[k] for x in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(" " in x["content"] for x in j["added_tokens"]):
            raise ValueError("added tokens that depend on their neighbours")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.specials = {x["content"]: x["id"] for x in j["added_tokens"]}
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.specials}
        self.names = {i: s for s, i in (model["vocab"] | self.specials).items()}
        self.transducer = Transducer(Merges(vocab, merges, most * 8 // 5), model["end_of_word_suffix"] or "", lookahead, most * 4 // 5)
        self.library = Tokenizer.from_file(path)
        self.own = j["normalizer"] == NORMALIZER and j["pre_tokenizer"] == PRE_TOKENIZER
        if not self.own and (self.library.pre_tokenizer is None or self._cut("a\tb c") != self._cut("a") + self._cut("b") + self._cut("c")):
            raise ValueError("the pre-tokenizer does not end its pieces at white space")
        self.piece, self.piece_or_space = regex.compile(PATTERN), regex.compile(f"{PATTERN}| ")
        self.odd = frozenset(odd)
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[[ord(c) for c in odd]] = True
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.words, self.chunks = Recent(most), Recent(most)

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a whole text."""
        for p in self._pieces(text):
            yield from self._ids(p)

    def _pieces(self, text: str) -> list[str]:
        """Special tokens, and between them the pattern's pieces in NFC and lower case."""
        if not self.special or not any(s in text for s in self.specials):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if self.own and text.isascii():
            return self.piece.findall(text.lower())
        if not self.own or not self.odd.isdisjoint(text):
            return self._cut(text)
        return self.piece.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _cut(self, text: str) -> list[str]:
        """The pieces as the library makes them."""
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(_BYTES[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, piece: str) -> Iterable[int]:
        special = self.specials.get(piece)
        return (special,) if special is not None else self.transducer.encode(piece.encode().decode("latin-1").translate(_TABLE))

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self.names)
        return d.feed(ids) + d.close()

    def both(self, text: str) -> tuple[bytes, bytes]:
        """The ids in decimal and the decoded text, each joined by one space. White space ends pieces, so the stretches
        between spaces are encoded, decoded and kept one by one; special tokens have no space in them."""
        stretches = text.replace("\n", " ").split(" ")
        now = self.chunks.now
        got = [now.get(c) or self._chunk(c) for c in stretches if c]
        return b"".join([x for x, _ in got])[:-1], b"".join([x for _, x in got])[:-1]

    def _chunk(self, c: str) -> tuple[bytes, bytes]:
        """The ids and the text of a stretch without spaces, with a space after each."""
        got = self.chunks.get(c)
        if got is None:
            found = [self._word(p) for p in self._pieces(c)]
            got = found[0] if len(found) == 1 else (b"".join([x for x, _ in found]), b"".join([x for _, x in found]))
            self.chunks.put(c, got)
        return got

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin and end. Arrow cuts texts into stretches as
        in both(), numbers the different ones and their pieces and puts the ids in their places; the transducer reads the
        different pieces together. Nothing is kept."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        stretches = cut.values.dictionary_encode()
        ids = self._stretches(stretches.dictionary).take(stretches.indices)
        return np.frombuffer(ids.buffers()[2] or b"", np.int32), _offsets(ids)[cut.offsets.to_numpy()] // 4

    def _stretches(self, stretches: pa.Array) -> pa.Array:
        """The ids of each stretch as 32-bit integers. Those that the library must cut, or with a special token, go by themselves."""
        text, alone = _joined(stretches), range(len(stretches))
        if self.own:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            alone = np.cumsum(code == 32)[self.is_odd[code]].tolist()
            for s in self.specials:
                if s in text:
                    alone += np.flatnonzero(pc.match_substring(stretches, s).to_numpy(zero_copy_only=False)).tolist()
        slow = {k: array.array("i", self.encode(stretches[k].as_py())).tobytes() for k in set(alone)}
        if slow:
            every = stretches.to_pylist()
            for k in slow:
                every[k] = ""
            text = " ".join(every)
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = pa.array([*self.piece_or_space.findall(text.lower()), " "], pa.large_string()).dictionary_encode()
        space = pieces.dictionary.index(" ").as_py()
        ids = self._pieces_ids(pieces.dictionary, space).take(pieces.indices)
        ends = _offsets(ids)[np.flatnonzero(pieces.indices.to_numpy() == space)]
        out = _binary(np.concatenate([[0], ends]), ids.buffers()[2])
        if slow:
            every = out.to_pylist()
            for k, x in slow.items():
                every[k] = x
            out = pa.array(every, pa.large_binary())
        return out

    def _pieces_ids(self, pieces: pa.Array, space: int) -> pa.Array:
        """The ids of different pieces as 32-bit integers, none for a space."""
        start = _offsets(pieces)
        data, size = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(start)
        long = np.flatnonzero(size > self.together.longest)
        other = size <= self.together.longest
        other[space] = False
        ids, ends = self.together.encode(data[: start[-1]][np.repeat(other, size)], np.concatenate([[0], np.cumsum(size[other])]))
        n = np.zeros(len(pieces), np.int64)
        n[other] = np.diff(ends)
        if len(long):  # a stream each
            every = {k: np.fromiter(self._ids(pieces[k].as_py()), np.int32) for k in long.tolist()}
            n[long] = [len(x) for x in every.values()]
            out = np.empty(n.sum(), np.int32)
            begin = np.cumsum(n) - n
            for k, x in every.items():
                out[begin[k] : begin[k] + n[k]] = x
            out[np.repeat(other, n)] = ids
            ids = out
        return _binary(4 * np.concatenate([[0], np.cumsum(n)]), pa.py_buffer(ids))

    @functools.cached_property
    def together(self) -> Together:
        return Together(self.transducer)

    def _word(self, p: str) -> tuple[bytes, bytes]:
        got = self.words.get(p)
        if got is None:
            ids = list(self._ids(p))
            got = "".join([f"{i} " for i in ids]).encode(), f"{self.decode(ids)} ".encode()
            if len(p) <= 40:
                self.words.put(p, got)
        return got


def _offsets(values: pa.Array) -> np.ndarray:
    """Where the bytes of each value of a large binary array begin, and the last end."""
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data])


def _joined(values: pa.Array) -> str:
    """All strings with a space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.scalar(" ", values.type))[0].as_py()


@functools.lru_cache(2)
def word_bpe(path: str, lookahead: int | None = None, kept: int = 250_000, odd: str = "") -> WordBpe:
    """One a process: Python workers run many tasks."""
    return WordBpe(path, lookahead, kept, odd)


@functools.lru_cache(8)
def sufficient_lookahead(path: str) -> int:
    return word_bpe(path).transducer.lookahead()


@functools.lru_cache(8)
def odd_characters(path: str) -> str:
    """All characters that the library, built with another version of Unicode, composes, lower-cases or classes otherwise
    than Python does: each is tried between a letter and a mark below. Planes without assigned characters are tried block
    by block only. Takes some seconds, once a driver."""
    bpe = word_bpe(path)
    blocks = [range(max(at, 128), at + 1024) for at in range(0, 0x110000, 1024) if not 0xD800 <= at < 0xE000]
    same = lambda text: bpe._plain(text) == bpe._cut(text)
    probe = lambda c: f"e{chr(c)}\u0323b"
    out: list[str] = []
    for block in blocks:
        quick = 0x40000 <= block[0] < 0xE0000 or block[0] >= 0xF0000
        if not same("".join(map(chr, block)) if quick else " ".join(map(probe, block))):
            out += [chr(c) for c in block if not same(probe(c))]
    return "".join(out)


def encode_decode(docs: DataFrame, tokenizer: str, digest: bool = False, kept: int = 250_000) -> DataFrame:
    """docs: doc_id, text; tokenizer: a file's path, readable on the executors. Returns doc_id, n_tokens and the ids and
    decoded text, or with digest=True their SHA-256 (ids in decimal joined by one space; text in UTF-8). kept: how many
    words and stretches a worker remembers, about 2 kB each in all; the results are the same with any number."""
    small_batches(docs.sparkSession)
    lookahead, odd = sufficient_lookahead(tokenizer), odd_characters(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer, lookahead, kept, odd)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                got = [bpe.both(x or "") for x in some["text"].to_pylist()]
                n = pa.array([ids.count(b" ") + 1 if ids else 0 for ids, _ in got], pa.int64())
                if digest:
                    columns = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (0, 1)]
                else:
                    flat = np.array(b" ".join([ids for ids, _ in got if ids]).split(), np.int32)
                    ends = np.concatenate([[0], np.cumsum(n.to_numpy())]).astype(np.int32)
                    columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([t.decode() for _, t in got], pa.string())]
                names = [x.split(" ")[0] for x in (DIGEST if digest else RESULT).split(", ")]
                yield pa.RecordBatch.from_arrays([some["doc_id"], n, *columns], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, DIGEST if digest else RESULT)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and ids as encode_decode gives them, without decoding them again. A worker keeps no words."""
    small_batches(docs.sparkSession)
    lookahead, odd = sufficient_lookahead(tokenizer), odd_characters(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer, lookahead, 20_000, odd)
        for some in (x for batch in batches for x in _parts(batch)):
            ids, at = bpe.flat(some["text"])
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(np.diff(at), pa.int64()), flat], names=["doc_id", "n_tokens", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ENCODED)


def _parts(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, a row at least."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(before // size)) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)
