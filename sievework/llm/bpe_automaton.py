"""BPE encoding and decoding with a tokenization automaton.

Built in two steps from the merges:

*Gadgets.* An automaton reads *tokens* and accepts exactly the token sequences
that byte pair encoding produces. It starts with one state and an arc for each
base symbol; every merge (u, v) -> t, in order of rank, adds its gadget:

* the state that u-arcs lead to is copied without its v-arc, and u-arcs now
  lead to the copy (u followed by v would have been merged);
* wherever a u-arc starts, a t-arc is added to the state that v-arcs led to.

All arcs of one label lead to one state, so states are named by the last token,
and a copy differs from its original by one arc: it is stored as that
difference, with its rank. ``arc()`` answers from these tables whether a state
has an arc.

*Determinised table.* Encoding reads *symbols*, one transition of a table each,
without search or backtracking. A state of that table holds every arc of the
token automaton that the last symbols may have entered: the part of its label
read so far and the tokens before it that are not settled. Tokens on which all
of these agree are settled: the transition emits them. Transitions are computed
when first reached and kept up to a bound.

Decoding emits the labels of the ids' arcs.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, raw_texts
from .pieces import SPECIAL, WordMemory, plain_pieces, rare_collections, special_parts

END = "</w>"
_BYTES = [bytes([b]) for b in range(256)]
#: Words that a Python worker remembers (two generations of them); pieces, arcs and states of the table follow in fixed shares. Some 0.7 kB each in all.
WORDS_KEPT = 600_000
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1 where visible, else from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class TokenAutomaton:
    """The gadgets: ``arc(state, token)`` over token numbers; a state is the last token, -1 at the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        symbols = byte_symbols()
        names = symbols + [s + END for s in symbols]
        self.rank: list[int] = [-1] * len(names)
        self.left: list[int] = [-1] * len(names)
        self.right: list[int] = [-1] * len(names)
        self.ids: list[int] = [vocab[n] for n in names]
        self.dropped: dict[tuple[int, int], int] = {}  # (state's token, token of the arc it lost): rank of that gadget
        at = {n: i for i, n in enumerate(names)}
        for rank, (u_name, v_name) in enumerate(merges):
            u, v = at[u_name], at[v_name]
            if not self.arc(u, v):
                continue
            self.dropped[u, v] = rank
            at[u_name + v_name] = len(names)
            names.append(u_name + v_name)
            self.rank.append(rank)
            self.left.append(u)
            self.right.append(v)
            self.ids.append(vocab[u_name + v_name])
        self.at = at
        self.label = {i: n for n, i in vocab.items()}

    def arc(self, state: int, token: int) -> bool:
        """Has the state after token ``state`` an arc for ``token``? Only gadgets older than a copy count for that copy."""
        a, until = state, len(self.dropped) + (1 << 40)
        while a >= 0:
            z, built = token, 1 << 40
            while z >= 0:
                lost = self.dropped.get((a, z))
                if lost is not None and lost < until and lost <= built:
                    return False
                built, z = self.rank[z], self.left[z]
            until, a = self.rank[a], self.right[a]
        return True


class SymbolTable:
    """The determinised automaton: each state has one successor for each symbol (a byte, and whether it is a word's last).

    A state is ``(anchor, open)``: the anchor is the last settled token; ``open``
    has, for each arc that may be under way, the tokens between the anchor and
    the arc's start, and the part of its label read so far. Once ``most`` states
    are kept, transitions that are not in the table are worked out each time.
    """

    def __init__(self, automaton: TokenAutomaton, most: int = WORDS_KEPT // 4, most_arcs: int = WORDS_KEPT * 5 // 6):
        code = {c: b for b, c in enumerate(byte_symbols())}
        self.automaton, self.most, self.most_arcs = automaton, most, most_arcs
        self.inner: dict[bytes, int] = {}  # label of a token within a word, of one that ends it
        self.last: dict[bytes, int] = {}
        for name, token in automaton.at.items():
            label = bytes([code[c] for c in name.removesuffix(END)])
            (self.last if name.endswith(END) else self.inner)[label] = token
        self.begun = {label[:k] for labels in (self.inner, self.last) for label in labels for k in range(1, len(label))}
        self.arcs: dict[int, bool] = {}
        start = (-1, (((), b""),))
        self.states, self.number = [start], {start: 0}
        self.next: dict[int, int] = {}  # state, symbol: next state, and whether ids are settled
        self.settled: dict[int, tuple[int, ...]] = {}

    def _arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= self.most_arcs:
                self.arcs.clear()
            found = self.arcs[key] = self.automaton.arc(state, token)
        return found

    def transition(self, state: tuple, byte: int, last: bool) -> tuple[tuple | None, tuple[int, ...]]:
        """The next state and the ids settled by this symbol."""
        (anchor, open_), labels, begun, symbol = state, self.last if last else self.inner, self.begun, _BYTES[byte]
        live, done = [], None
        for path, read in open_:
            label = read + symbol
            if not last and label in begun:
                live.append((path, label))
            if done is None and (token := labels.get(label)) is not None:
                before = path[-1] if path else anchor
                if before < 0 or self._arc(before, token):
                    done = (*path, token)  # byte pair encoding is a function, so no other path ends here
        if done is None:
            raise ValueError(f"no path reads byte {byte}")
        ids = self.automaton.ids
        if last:
            return None, tuple([ids[t] for t in done])
        same = len(done) if not live or live[0][0] else 0  # the first arc under way began earliest
        for path, _ in live if same else ():
            if len(path) < same:
                same = len(path)
            while path[:same] != done[:same]:
                same -= 1
            if not same:
                break
        if not same:
            return (anchor, (*live, (done, b""))), ()
        open_ = (*[(path[same:], label) for path, label in live], (done[same:], b""))
        return (done[same - 1], open_), tuple([ids[t] for t in done[:same]])

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, given as its bytes.

        The first transition that is not in the table yet is added, so words
        that are met again lead one symbol further; the rest is read without it.
        """
        if not piece:
            return []
        following, settled, at, out, end = self.next, self.settled, 0, [], len(piece) - 1
        for i, byte in enumerate(piece):
            key = at << 9 | (i == end) << 8 | byte
            found = following.get(key)
            if found is None:
                if len(self.states) < self.most:
                    self._add(key, byte, i == end)
                return out + self._untabled(self.states[at], piece, i)
            if found & 1:
                out += settled[key]
            at = found >> 1
        return out

    def _add(self, key: int, byte: int, last: bool) -> None:
        state, ids = self.transition(self.states[key >> 9], byte, last)
        number = 0
        if state is not None and (number := self.number.setdefault(state, len(self.states))) == len(self.states):
            self.states.append(state)
        if ids:
            self.settled[key] = ids
        self.next[key] = number << 1 | bool(ids)

    def _untabled(self, state: tuple, piece: bytes, start: int) -> list[int]:
        """The same transitions without their states' names: tokens are chains ``(the ones before, token)``, settled all at the end."""
        anchor, live = state[0], []
        for path, read in state[1]:
            chain = None
            for token in path:
                chain = (chain, token)
            live.append((chain, read))
        labels, begun, arcs, end, done = self.inner, self.begun, self.arcs, len(piece) - 1, None
        for i in range(start, end + 1):
            symbol = piece[i : i + 1]
            if i == end:
                labels = self.last
            done, later = None, []
            for part in live:
                chain, read = part
                label = read + symbol
                if label in begun:
                    later.append((chain, label))
                if done is None and (token := labels.get(label)) is not None:
                    before = chain[1] if chain else anchor
                    if before < 0 or (found := arcs.get(before << 20 | token)) or (found is None and self._arc(before, token)):
                        done = (chain, token)
            if done is None:
                raise ValueError(f"no path reads {piece!r}")
            later.append((done, b""))
            live = later
        out = []
        while done:
            done, token = done
            out.append(self.automaton.ids[token])
        return out[::-1]


class WordCoder:
    """Ids and labels of a word, as text ready to be joined."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.automaton.label |= {i: s for s, i in SPECIAL.items()}
        self.table = SymbolTable(self.automaton, words_kept // 4, words_kept * 5 // 6)
        # Only for words beyond Latin-1: the library's own Unicode tables normalise and cut them.
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        self.code = {c: b for b, c in enumerate(byte_symbols())}
        self.pieces = WordMemory(self._piece, words_kept * 2 // 3)
        self.words = WordMemory(self._word, words_kept)

    def _piece(self, piece: bytes) -> tuple[bytes, bytes]:
        return self._coded(self.table.encode(piece))

    def _coded(self, ids: list[int]) -> tuple[bytes, bytes]:
        """The ids and their labels as text, each led in by a blank; labels have no blanks."""
        return "".join([f" {i}" for i in ids]).encode(), f" {self.decode(ids)}".encode() if ids else b""

    def decode(self, ids: list[int]) -> str:
        label = self.automaton.label
        return " ".join([label[i] for i in ids])

    def _parts(self, word: str) -> list[tuple[bytes, bytes]]:
        out = []
        for part in special_parts(word) if "<|" in word else (word,):
            if part in SPECIAL:
                out.append(self._coded([SPECIAL[part]]))
            elif (plain := plain_pieces(part)) is not None:
                out += [self.pieces[p.encode()] for p in plain]
            else:
                out += [self.pieces[bytes([self.code[c] for c in p])] for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        parts = self._parts(word.decode())
        return parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))

    def text(self, raw: bytes) -> tuple[int, bytes, bytes]:
        words = raw.split()
        if not words:
            return 0, b"", b""
        ids, labels = zip(*map(self.words.__getitem__, words))
        ids = b"".join(ids)
        return ids.count(b" "), ids[1:], b"".join(labels)[1:]


_coders: dict[tuple[str, int], WordCoder] = {}


def coder(path: str, words_kept: int) -> WordCoder:
    """Compiled once for each Python worker."""
    if (path, words_kept) not in _coders:
        rare_collections()
        _coders[path, words_kept] = WordCoder(path, words_kept)
    return _coders[path, words_kept]


def bpe_encode_decode(docs: DataFrame, vocabulary: str, *, digests: bool = False, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    Null and empty texts have no tokens and decode to an empty text. Repeated
    rows come back repeated; other columns are left aside. ``ids`` are decimal
    and joined by one blank; with ``digests`` the two texts are replaced by
    their SHA-256. ``words_kept`` bounds what a worker remembers, not the result.
    """

    def make():
        words = coder(vocabulary, words_kept)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, texts = zip(*map(words.text, raw_texts(part["text"])), strict=True) if part.num_rows else ((), (), ())
            if digests:
                ids, texts = ([hashlib.sha256(x).hexdigest() for x in col] for col in (ids, texts))
            else:
                ids, texts = ([x.decode() for x in col] for col in (ids, texts))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
            return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=names)

        return step

    return map_slices(id_and_text(docs), make, DIGESTS if digests else SCHEMA)
