"""Problem 8: encoding a corpus with a public byte-pair tokenizer.

A bounded-lookahead streaming transducer. Text is cut into pre-tokens that are final
once a few further characters are known; a pre-token's bytes go through a transducer
that knows, for every prefix, the last token of the prefix's encoding: the one vocabulary
entry ending there that may follow the last token of the rest. Every later encoding
passes through one of the last ``lookahead`` positions, ``lookahead`` being the longest
token that the merge list can build, so tokens before the common ancestor of these
positions are stable and are emitted at once. Memory is bounded by the lookahead, not by
the text. Short pre-tokens repeat a lot and are remembered.

Defined results: null and empty texts have the empty list of ids; strings that look like
special tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-token pattern of the public tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after a pre-token that can still change it.
MARGIN = 3
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id of a rank file (base64 token, blank, rank per line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Transducer:
    """Vocabulary with the facts that streaming needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Longest token in bytes: the sufficient lookahead.
        self.lookahead = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: Last two bytes of a position to the lengths of tokens that may end there.
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a short piece: the pair of lowest rank is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side in an encoding."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of a complete pre-token by the byte transducer; those of short ones are remembered."""
        ids = self.memory.get(text)
        if ids is None:
            stream = PieceStream(self)
            ids = [*stream.feed(text.encode("utf-8")), *stream.end()]
            if len(text) <= 40:
                if len(self.memory) > 300_000:
                    self.memory.clear()
                self.memory[text] = ids
        return ids


class PieceStream:
    """Streaming encoding of the bytes of one pre-token."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.window = b""  # bytes from ``base`` on
        self.base = 0  # position of the last emitted boundary
        self.last: list[int] = [-1]  # last token of the prefix that ends at base + i

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for i in range(len(raw)):
            self._step(raw[i : i + 1])
            # the check costs a walk back, so it is made once per lookahead
            if len(self.window) >= 4 * self.t.lookahead and len(self.window) % self.t.lookahead == 0:
                out += self._stable()
        return out

    def _step(self, byte: bytes) -> None:
        self.window += byte
        window, last, t = self.window, self.last, self.t
        end = len(window)
        for length in (*t.lengths.get(window[-2:], ()), 1):
            start = end - length
            if start < 0 or (length > 1 and start > end - 2):
                continue
            token = t.ranks.get(window[start:end])
            if token is None:
                continue
            if start == 0 and self.base == 0 or last[start] >= 0 and t.fits(last[start], token):
                last.append(token)
                return
            if start == 0 and last[0] == -1:
                last.append(token)
                return
        last.append(-2)  # no encoding of this prefix ends here

    def _path(self, end: int) -> list[int]:
        """Boundaries of the encoding of the prefix that ends at ``end``, from the back."""
        at, out = end, []
        while at > 0:
            out.append(at)
            at -= len(self.t.tokens[self.last[at]])
        return out

    def _stable(self) -> list[int]:
        end = len(self.window)
        common: set[int] | None = None
        for position in range(max(1, end - self.t.lookahead + 1), end + 1):
            if self.last[position] >= 0:
                path = set(self._path(position))
                common = path if common is None else common & path
                if not common:
                    return []
        cut = max(common) if common else 0
        ids = self._ids(cut)
        self.base += cut
        self.window = self.window[cut:]
        self.last = self.last[cut:]
        return ids

    def _ids(self, end: int) -> list[int]:
        return [self.last[at] for at in reversed(self._path(end))]

    def end(self) -> list[int]:
        ids = self._ids(len(self.window))
        self.window, self.last, self.base = b"", [-1], 0
        return ids


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


class TextStream:
    """Incremental encoder: ``feed`` chunks of a text, then ``end``.

    What is kept between calls is the unfinished pre-token, and of a long one (a run of
    one character class) only its last characters and the transducer's window.
    """

    #: Characters of an unfinished pre-token from which on its bytes are streamed.
    OPEN_FROM = 1024

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.rest = ""
        self.open: PieceStream | None = None
        self.run = None  # pattern of the run that the open pre-token consists of

    def feed(self, chunk: str) -> list[int]:
        self.rest += chunk
        return self._take(final=False)

    def end(self, chunk: str = "") -> list[int]:
        """The rest of the ids, after a last chunk if there is one."""
        self.rest += chunk
        return self._take(final=True)

    def _take(self, final: bool) -> list[int]:
        out: list[int] = []
        while self.open is not None:
            out += self._continue(final)
            if self.open is not None:
                return out
        text, at = self.rest, 0
        for match in _pattern().finditer(text):
            if not final and match.end() > len(text) - MARGIN:
                if match.end() - at >= self.OPEN_FROM:
                    self.open, self.run = PieceStream(self.t), _run_of(match.group()[-MARGIN])
                    out += self.open.feed(match.group()[:-MARGIN].encode("utf-8"))
                    at = match.end() - MARGIN
                break
            out += self.t.piece(match.group())
            at = match.end()
        self.rest = text[at:]
        return out

    def _continue(self, final: bool) -> list[int]:
        """More of the open pre-token; it is closed once its end is known."""
        length = self.run.match(self.rest).end()
        ended = final or length <= len(self.rest) - MARGIN
        take = length if ended else max(0, length - MARGIN)
        if ended and self.run is _runs()[3] and length < len(self.rest):
            take -= 1  # the last white space before a word belongs to what follows
        out = self.open.feed(self.rest[:take].encode("utf-8"))
        self.rest = self.rest[take:]
        if ended:
            out += self.open.end()
            self.open = None
        return out


@lru_cache(maxsize=1)
def _runs():
    import regex

    return tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*"))


def _run_of(char: str):
    return next(r for r in _runs() if r.match(char).end())


class TextDecoder:
    """Incremental ids-to-text state machine; bytes of an unfinished character wait."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(self.t.tokens[i] for i in ids))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


_LOADED: dict[int, Transducer] = {}


def _transducer(raw: bytes) -> Transducer:
    key = hash(raw)
    if key not in _LOADED:
        _LOADED[key] = Transducer(parse_ranks(raw))
    return _LOADED[key]


#: Characters that the streaming encoder is given at once.
CHUNK = 1 << 16


def encode_text(transducer: Transducer, text: str | None) -> list[int]:
    """Ids of a text, which goes through the streaming encoder chunk by chunk."""
    if not text:
        return []
    stream, out, last = TextStream(transducer), [], (len(text) - 1) // CHUNK * CHUNK
    for at in range(0, last, CHUNK):
        out += stream.feed(text[at : at + CHUNK])
    return out + stream.end(text[last:])


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 2000):
                ids = pa.array([encode_text(transducer, t) for t in texts[a : a + 2000]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, 2000), ids], [batch.schema.names[0], "ids"])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = TextDecoder(transducer)
                texts.append(decoder.feed(ids or []) + decoder.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return run


def _shared(df: DataFrame, path: str):
    """The rank file, read once on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_corpus(documents: DataFrame, key: str = "doc_id", column: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids) of each row."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(column)).mapInArrow(_encode(_shared(documents, ranks_path)), f"{key} {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, text) of encoded rows; invalid byte sequences become U+FFFD."""
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col("ids")).mapInArrow(_decode(_shared(encoded, ranks_path)), f"{key} {kind}, text string")
