"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Encoding is the backtracking method: an Aho-Corasick automaton gives the longest vocabulary
token at each byte offset; tokens are taken greedily and checked, pair by pair, against the
merge rules (may these two tokens stand next to each other?); on a clash the last token is
shortened to its next longest prefix token, on a dead end the walk steps back. Each offset is
left for good at most once, so the walk is linear, and its result equals that of applying the
merges in rank order. Pieces that the pattern yields are remembered by each worker (a bounded
table), since words repeat. Decoding gathers bytes through a table of offsets into one buffer.

Defined results: null texts are empty; an empty text has no ids and decodes to the empty text;
the special strings of the vocabulary are single ids, as the library has them. Only doc_id and text of
the input are used, so other columns can't clash; repeated rows are coded each; a long text is held whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by a worker, twice (the last and the present generation).
CACHE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """Encoder and decoder for one vocabulary file (``tokenizers`` JSON, byte level)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.vocab = vocab
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(back[c] for c in a), bytes(back[c] for c in b)
            new = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = (rank, new)
            self.split.setdefault(new, (vocab[a], vocab[b], rank))
        # The longest proper prefix of each token that is a token itself.
        self.shorter = [-1] * size
        for t, i in vocab.items():
            self.shorter[i] = next((vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        lens = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.table, self.starts, self.lens = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8), np.concatenate([[0], np.cumsum(lens)[:-1]]), lens
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Would merging in rank order leave these two tokens side by side? Kept in a table."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 4 * CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._check_pair(left, right)
        return known

    def _check_pair(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens, latest first. Whenever the two parts that meet at the
        # seam have a rule of their own that comes before the merge just undone, that rule would
        # have taken precedence. Of equal ranks the left merge is made first: hence the + 1.
        limit = len(self.pair) + 1
        while True:
            hit = self.pair.get((left, right))
            if hit is not None and hit[0] < limit:
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            else:
                limit, right = b[2] + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        whole = self.vocab.get(piece)
        if n == 1:
            return [whole]
        longest = [-1] * n
        size = [0] * n
        for end, (k, i) in self.automaton.iter(piece.decode("latin-1")):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, i
        shorter, text = self.shorter, self.bytes_of
        open_at = bytearray(b"\x01") * (n + 1)
        known = self.compatible.get
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + len(text[token])
                if open_at[end] and (last < 0 or (self.may_follow(last, token) if (fits := known((last, token))) is None else fits)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
                if token < 0:
                    open_at[at] = 0
                    if not out:
                        raise ValueError("no encoding: the vocabulary lacks single bytes")
                    token = out.pop()
                    at -= len(text[token])
                    last = out[-1] if out else -1
                    # The same token fails now, since its end is closed.
            if at == n:
                return out

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two single spaces, with the space before it, or of a line feed and what follows it."""
        ids = self.before.get(chunk)
        if ids is None:
            pieces = self.find(chunk if chunk[0] == "\n" else " " + chunk)
            ids = b"".join([self._piece(p) for p in pieces])
        if len(chunk) <= 64:
            if len(self.known) >= CACHE:
                self.before, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else self._encode(p) for p in parts if p])
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        # Where every white space is one space or line feed between two other characters, the
        # pattern never matches across the place before it, so such chunks can be remembered.
        words = text.split()
        gaps = len(words) - 1
        if len(text) - len("".join(words)) != gaps or text.count(" ") + text.count("\n") != gaps:
            return b"".join([self._piece(p) for p in self.find(text)])
        first, *chunks = text.replace("\n", " \n").split(" ")
        known = self.known
        out = [self._piece(p) for p in self.find(first)]
        try:
            out += [known[c] for c in chunks]
        except KeyError:
            out += [known.get(c) or self._chunk(c) for c in chunks]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; invalid sequences become U+FFFD, as in the library."""
        i = np.frombuffer(ids, dtype="<u4")
        if not len(i):
            return b""
        n = self.lens[i]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[i] - (ends - n), n)
        raw = self.table[at].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, BacktrackingBpe] = {}


def loaded(path: str) -> BacktrackingBpe:
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(df, path: str | None = None, *, ids: bool = True):
    """(doc_id, text) -> doc_id, n_tokens, ids and decoded text as binaries, or only their digests (``ids=False``)."""
    fixed = path or default_vocabulary()

    def run(batches):
        coder = loaded(fixed)
        for batch in batches:
            keys, count, one, two = [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                got = coder.encode(text.as_py() or "")
                back = coder.decode(got)
                count.append(len(got) // 4)
                one.append(got if ids else hashlib.sha256(got).hexdigest())
                two.append(back if ids else hashlib.sha256(back).hexdigest())
            kind = pa.binary() if ids else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(one, kind), pa.array(two, kind)], names=names)

    kind = "binary" if ids else "string"
    names = ["doc_id", "n_tokens", "ids", "decoded"] if ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    slim = df.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")


def op10_bpe(spark, sf_dir: str):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
