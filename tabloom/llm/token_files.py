"""Token-id files: adaptive context mixing over ids of order 0 to 2, a range coder, independent blocks.

A block holds whole documents.  Its ids are cut into ``LANES`` streams that are
coded side by side under one model, so that a step of the coder is a few array
operations over the lanes of many blocks.  The model predicts an id from the
two ids before it (order 2), from the one before it (order 1), and from what
has been frequent in the block (order 0).  How much each is trusted depends on
how well the first two did lately: their hits are counted by state, and the
counts set the mixture.  What is learnt takes effect at fixed steps, in the coder
and the decoder alike: between them the coder models all steps at once.  The
mixture drives a range coder with 48-bit state and 24-bit output, whose carries
are added up when a block is done.

Every block starts with a fresh model and carries checksums of its bytes and of
its ids.  Blocks are rows of a written table: a task that is lost is run again,
and its files appear whole or not at all.

A text is split at blanks and line ends, and before punctuation that ends a
word, ahead of the tokenizer, which never joins across these places and takes
case off itself.  Pieces are remembered from text to text, and new ones of plain
letters go through the tokenizer's model alone, many at once.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tabloom.llm.text import picked, whole_text

END_ID = 1
LANES = 512
BLOCK_IDS = 1 << 18
GROUP = 8
VOCABULARY = 49_408
PIECE_CHARS = 1 << 21  # code points that are encoded together: arrays of ids take some fifty bytes each
MEMORY = 300_000  # pieces a worker remembers
ENCODED_AT_ONCE = 1000
# Texts are cut before punctuation that ends a word; marks that special tokens are made of are left there if a text may hold one.
WORD_END = r"([a-zß-öø-ÿ])([.,;:!?]+( |$))"
WORD_END_PLAIN = r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+( |$))"
LETTERS = r"^[a-zÀ-ÖØ-öø-ÿ]+$"

MAGIC = b"TKRC"
VERSION = 2
HEAD = struct.Struct("<4sHHIIIII")  # magic, version, lanes, documents, ids, vocabulary, crc of ids, crc of the rest
WORD_BITS = 24
WORD = 2.0**WORD_BITS
TOP = WORD * WORD  # a lane's span is at most so large, and at least a word between two steps
TOTAL_BITS = 22
ORDER0_BITS = 18
TOTAL, SLOTS = 2.0**TOTAL_BITS, 2.0**ORDER0_BITS
CONTEXTS = 1 << 16
STATES = 32
TRUST = np.uint32(1 << 19), np.uint32(1 << 17)  # apart, so that entries of both orders give the state
GAIN = 16  # of an id seen, against the prior
LEARN_EVERY = 8
REFRESH_AT = (2, 8, 32, 96)
REFRESH_EVERY = 256


class Mixer:
    """The adaptive model of some blocks, and what it says of their lanes.

    Ids are rows of steps with two rows of zeros before the first, so that step ``t`` is row ``t + 2``.
    """

    def __init__(self, blocks: int, vocabulary: int, decoding: bool):
        self.v = vocabulary
        self.tables = [np.zeros(blocks * CONTEXTS, np.uint32) for _ in range(2)]  # an id, and how far it is trusted in units of TRUST
        prior = (1 << 12) // (np.arange(vocabulary, dtype=np.int64) + 16) + 1
        self.counts = np.tile(prior, (blocks, 1))
        self.hits = np.tile(np.array([1, 1, 2], np.int64), (blocks, STATES, 1))
        self.freq, self.cum = np.zeros((blocks, vocabulary)), np.zeros((blocks, vocabulary))
        self.slots = np.zeros((blocks, 1 << ORDER0_BITS), np.uint16) if decoding else None
        self.edge, self.m0 = np.zeros((blocks, STATES)), np.zeros((blocks, STATES))
        lane = np.repeat(np.arange(blocks, dtype=np.int64), LANES)
        self.context, self.symbol, self.state = lane * CONTEXTS, lane * vocabulary, lane * STATES
        self.slot = lane << ORDER0_BITS
        self._refresh(blocks)
        self._weigh(blocks)

    def count(self, blocks: int, ids: np.ndarray) -> None:
        """Take in the ids of the steps since the last time, for order 0."""
        n = blocks * LANES
        seen = np.bincount((ids[:, :n] + self.symbol[:n]).ravel(), minlength=blocks * self.v)
        self.counts[:blocks] += GAIN * seen.reshape(blocks, self.v)
        self._refresh(blocks)

    def _refresh(self, blocks: int) -> None:
        total = 1 << ORDER0_BITS
        for b in range(blocks):
            counts = self.counts[b]
            freq = counts * (total - self.v) // counts.sum() + 1
            freq[0] += total - freq.sum()
            self.freq[b] = freq
            np.cumsum(freq[:-1], out=self.cum[b, 1:])
            if self.slots is not None:
                self.slots[b] = np.repeat(np.arange(self.v, dtype=np.uint16), freq)

    def _weigh(self, blocks: int) -> None:
        h = self.hits[:blocks]
        all_, most = h.sum(axis=2), (1 << TOTAL_BITS - ORDER0_BITS) - 1
        m0 = np.clip(((most + 1) * h[:, :, 2] + all_ // 2) // all_, 1, most)
        rest = (1 << TOTAL_BITS) - (m0 << ORDER0_BITS)
        w2 = np.clip(rest * h[:, :, 0] // (h[:, :, 0] + h[:, :, 1]), 1, rest - 1)
        w2[:, 1::2] = rest[:, 1::2]  # both orders say the same id
        self.edge[:blocks], self.m0[:blocks] = (1 << TOTAL_BITS) - w2, m0

    def predict(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """By the two ids before: places and entries in the tables, the ids there, and the state."""
        n = last.shape[-1]
        one = last + self.context[:n]
        two = last * 40503
        two += before
        two &= CONTEXTS - 1
        two += self.context[:n]
        e2, e1 = self.tables[0].take(two, mode="clip"), self.tables[1].take(one, mode="clip")
        c2, c1 = e2 & 0xFFFF, e1 & 0xFFFF
        state = (e2 | e1) >> 16
        state += c2 == c1
        return two, one, e2, e1, c2, c1, state + self.state[:n]

    def mixture(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the room of order 2 begins, which is the last, and the room of a slot of order 0, which is the first."""
        return self.edge.ravel().take(state, mode="clip"), self.m0.ravel().take(state, mode="clip")

    def learn(self, x: np.ndarray, two, one, e2, e1, c2, c1, state) -> None:
        """Take in steps: the tables, and which order was right in which state."""
        hit2, hit1 = c2 == x, c1 == x
        for at, e, c, hit, unit, table in ((two, e2, c2, hit2, TRUST[0], self.tables[0]), (one, e1, c1, hit1, TRUST[1], self.tables[1])):
            table[at.ravel()] = np.where(hit, np.minimum(e + unit, c + 3 * unit), np.where(e >= unit, e - unit, x)).ravel()
        outcome = np.where(hit2, 0, 2 - hit1)
        outcome += state * 3
        self.hits += np.bincount(outcome.ravel(), minlength=self.hits.size).reshape(self.hits.shape)
        self._weigh(x.shape[1] // LANES)


def _steps(n: int) -> int:
    return max(1, -(-n // LANES))


def _spans(most: int) -> list[tuple[int, int]]:
    """First and last step between which nothing is learnt: the same for every block, however long."""
    at = sorted({*range(0, most, LEARN_EVERY), *(t for t in REFRESH_AT if t < most), most})
    return list(zip(at, at[1:]))


def _refreshes(step: int) -> bool:
    return step in REFRESH_AT or (step > 0 and step % REFRESH_EVERY == 0)


def encode_blocks(blocks: list[np.ndarray], vocabulary: int = VOCABULARY) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words per lane and all words of each block of ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    steps = [_steps(len(blocks[i])) for i in order]
    most, n_all = steps[0], len(blocks) * LANES
    ids = np.full((most + 2, n_all), END_ID, np.int64)
    ids[:2] = 0
    for b, i in enumerate(order):
        padded = np.full(steps[b] * LANES, END_ID, np.int64)
        padded[: len(blocks[i])] = blocks[i]
        ids[2 : steps[b] + 2, b * LANES : (b + 1) * LANES] = padded.reshape(LANES, steps[b]).T
    model = Mixer(len(blocks), vocabulary, decoding=False)
    # Whole numbers below 2**53, kept as floats for the speed of their arithmetic; a carry lies in bit 24 of a word.
    low, span = np.zeros(n_all), np.full(n_all, TOP)
    room = most + 2
    out, first = np.zeros(n_all * room, np.uint32), np.arange(n_all) * room
    place = first.copy()
    counted, active, running = 0, len(blocks), len(blocks)
    for t, end in _spans(most):
        while steps[active - 1] <= t:
            active -= 1
        n = active * LANES
        if _refreshes(t):
            model.count(active, ids[counted + 2 : t + 2])
            counted = t
        told = model.predict(ids[t:end, :n], ids[t + 1 : end + 1, :n])
        *_, c2, c1, state = told
        edge, m0 = model.mixture(state)
        x = ids[t + 2 : end + 2, :n]
        symbol = x + model.symbol[:n]
        x = x.astype(np.uint32)
        by2, by1, one = c2 == x, c1 == x, m0 * SLOTS
        start = np.where(by2, edge, np.where(by1, one, model.cum.ravel().take(symbol, mode="clip") * m0))
        size = np.where(by2, TOTAL - edge, np.where(by1, edge - one, model.freq.ravel().take(symbol, mode="clip") * m0))
        for k in range(end - t):
            while steps[running - 1] <= t + k:
                running -= 1
            m = running * LANES
            part = np.floor(span[:m] * (1 / TOTAL))
            low[:m] += start[k, :m] * part
            np.multiply(size[k, :m], part, out=span[:m])
            short = np.flatnonzero(span[:m] < WORD)
            rest = low[short]
            word = np.floor(rest * (1 / WORD))
            at = place[short]
            out[at] = word
            place[short] = at + 1
            low[short] = (rest - word * WORD) * WORD
            span[short] *= WORD
        going = sum(s > end for s in steps) * LANES
        if going:
            model.learn(x[:, :going], *(a[:, :going] for a in told))
    word = np.floor(low * (1 / WORD))
    out[place], out[place + 1] = word, low - word * WORD
    sizes = place + 2 - first
    made: list = [None] * len(blocks)
    for b, i in enumerate(order):
        own = sizes[b * LANES : (b + 1) * LANES]
        words = out[b * LANES * room : (b + 1) * LANES * room].reshape(LANES, room)[np.arange(room) < own[:, None]]
        while (carry := words >> WORD_BITS).any():  # never out of the first word of a lane
            words &= (1 << WORD_BITS) - 1
            words[:-1] += carry[1:]
        made[i] = (own, words)
    return made


def decode_blocks(coded: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: int = VOCABULARY) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, words per lane, all words)."""
    order = sorted(range(len(coded)), key=lambda i: -coded[i][0])
    steps = [_steps(coded[i][0]) for i in order]
    most, n_all = steps[0], len(coded) * LANES
    words = np.concatenate([coded[i][2] for i in order])
    sizes = np.concatenate([coded[i][1] for i in order]).astype(np.int64)
    at = np.cumsum(sizes) - sizes
    code = words[at] * WORD + words[at + 1]
    at += 2
    model = Mixer(len(coded), vocabulary, decoding=True)
    span = np.full(n_all, TOP)
    ids = np.zeros((most + 2, n_all), np.int64)
    counted, active = 0, len(coded)
    freq, cum, slots = model.freq.ravel(), model.cum.ravel(), model.slots.ravel()
    for t, end in _spans(most):
        if _refreshes(t):
            model.count(sum(s > t for s in steps), ids[counted + 2 : t + 2])
            counted = t
        told = []
        for k in range(t, end):
            while steps[active - 1] <= k:
                active -= 1
            n = active * LANES
            told.append(model.predict(ids[k, :n], ids[k + 1, :n]))
            *_, c2, c1, state = told[-1]
            edge, m0 = model.mixture(state)
            part = np.floor(span[:n] * (1 / TOTAL))
            value = np.floor(code[:n] / part)  # exact: both are below 2**53 and the quotient is below 2**24
            slot = value / m0
            by2, known = value >= edge, slot >= SLOTS
            slot = slot.astype(np.int64)
            slot += model.slot[:n]
            x = np.where(by2, c2, np.where(known, c1, slots.take(slot, mode="clip")))
            ids[k + 2, :n] = x
            symbol = x + model.symbol[:n]
            one = m0 * SLOTS
            start = np.where(by2, edge, np.where(known, one, cum.take(symbol, mode="clip") * m0))
            size = np.where(by2, TOTAL - edge, np.where(known, edge - one, freq.take(symbol, mode="clip") * m0))
            start *= part
            code[:n] -= start
            np.multiply(size, part, out=span[:n])
            short = np.flatnonzero(span[:n] < WORD)
            place = at[short]
            code[short] = code[short] * WORD + words.take(place, mode="clip")
            at[short] = place + 1
            span[short] *= WORD
        going = sum(s > end for s in steps) * LANES
        if going:
            model.learn(ids[t + 2 : end + 2, :going].astype(np.uint32), *(np.stack([a[:going] for a in column]) for column in zip(*told)))
    made: list = [None] * len(coded)
    for b, i in enumerate(order):
        own = ids[2 : steps[b] + 2, b * LANES : (b + 1) * LANES].T.reshape(-1)
        made[i] = own[: coded[i][0]]
    return made


def _groups(sizes: list[int]) -> list[list[int]]:
    """Blocks to code side by side: a block that is much longer than others goes alone, as all would take its room."""
    long = [k for k, n in enumerate(sizes) if n > 2 * BLOCK_IDS]
    rest = [k for k, n in enumerate(sizes) if n <= 2 * BLOCK_IDS]
    return [[k] for k in long] + [rest] * bool(rest)


def _as_bytes(words: np.ndarray) -> bytes:
    """The three low bytes of each word."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _as_words(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return parts[:, 0] + parts[:, 1] * 2.0**8 + parts[:, 2] * 2.0**16


def pack_blocks(blocks: list[list[np.ndarray]], vocabulary: int = VOCABULARY) -> list[bytes]:
    """The bytes of blocks of documents."""
    flat = [np.concatenate(docs) for docs in blocks]
    coded: list = [None] * len(flat)
    for group in _groups([len(ids) for ids in flat]):
        for k, made in zip(group, encode_blocks([flat[k] for k in group], vocabulary)):
            coded[k] = made
    out = []
    for docs, ids, (sizes, words) in zip(blocks, flat, coded):
        body = np.array([len(d) for d in docs], "<u4").tobytes() + sizes.astype("<u4").tobytes() + _as_bytes(words)
        out.append(
            HEAD.pack(MAGIC, VERSION, LANES, len(docs), len(ids), vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body
        )
    return out


def unpack_blocks(data: list[bytes]) -> list[list[np.ndarray]]:
    """The documents of blocks; a block whose checksums fail raises ``ValueError``."""
    coded, lengths, checks, vocabulary = [], [], [], VOCABULARY
    for raw in data:
        magic, version, lanes, n_docs, n_ids, vocabulary, id_crc, crc = HEAD.unpack_from(raw)
        body = raw[HEAD.size :]
        if magic != MAGIC or version != VERSION or lanes != LANES or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        lengths.append(np.frombuffer(body, "<u4", n_docs))
        sizes = np.frombuffer(body, "<u4", lanes, 4 * n_docs)
        coded.append((n_ids, sizes, _as_words(body[4 * (n_docs + lanes) :])))
        checks.append(id_crc)
    flat: list = [None] * len(coded)
    for group in _groups([n for n, _, _ in coded]):
        for k, ids in zip(group, decode_blocks([coded[k] for k in group], vocabulary)):
            flat[k] = ids
    out = []
    for ids, sizes, check in zip(flat, lengths, checks):
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("damaged ids")
        out.append(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return out


class Encoder:
    """Ids of texts by a tokenizer, without special tokens of its own, with ``END_ID`` after each text.

    Pieces met before are remembered, up to ``MEMORY`` of them; those not met again are the first to go.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.of_letters = _LetterWords.of(tokenizer)
        self.number: dict[str, int] = {}
        self.begin, self.size, self.every = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.again = np.zeros(0, bool)

    def forget(self) -> None:
        keep = np.flatnonzero(self.again)[-MEMORY // 2 :]
        pieces = list(self.number)
        self.number = {pieces[k]: i for i, k in enumerate(keep.tolist())}
        self.every = self.every[_places(self.begin[keep], self.size[keep])]
        self.size = self.size[keep]
        self.begin, self.again = np.cumsum(self.size) - self.size, np.zeros(len(keep), bool)

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of some distinct pieces, and all the ids."""
        plain = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False) & (self.of_letters is not None)
        size = np.zeros(len(pieces), np.int64)
        letters, others = _joined(pieces.filter(pa.array(plain))), _joined(pieces.filter(pa.array(~plain))).split(" ")
        size[plain], ids = self.of_letters(letters) if plain.any() else (0, self.every[:0])
        found = []
        for k in range(0, len(others), ENCODED_AT_ONCE) if not plain.all() else ():
            found += [e.ids for e in self.tokenizer.encode_batch_fast(others[k : k + ENCODED_AT_ONCE], add_special_tokens=False)]
        size[~plain] = np.fromiter(map(len, found), np.int64, len(found))
        every, owner = np.empty(size.sum(), np.uint16), np.repeat(plain, size)
        every[owner] = ids
        every[~owner] = np.fromiter(chain.from_iterable(found), np.uint16)
        return size, every

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        if len(self.number) > MEMORY:
            self.forget()
        names, known = _joined(pieces).split(" "), len(self.number)
        codes = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names)) if len(pieces) else np.zeros(0, np.int64)
        fresh = np.flatnonzero(codes < 0)
        self.again[codes[codes >= 0]] = True
        if len(fresh):
            size, every = self._encoded(pieces.take(pa.array(fresh)))
            codes[fresh] = np.arange(known, known + len(fresh))
            self.number.update(zip(map(names.__getitem__, fresh.tolist()), range(known, known + len(fresh))))
            self.size, self.every = np.concatenate([self.size, size]), np.concatenate([self.every, every])
            self.begin = np.cumsum(self.size) - self.size
            self.again = np.concatenate([self.again, np.zeros(len(fresh), bool)])
        return codes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin, with the end."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        if not special:  # else a special token might be made of others
            texts = pc.ascii_lower(texts)
        parted = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_END if special else WORD_END_PLAIN, r"\1 \2")
        lists = pc.split_pattern(parted, " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        word = self._codes(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        begin, size = np.insert(self.begin[word], ends, len(self.every)), np.insert(self.size[word], ends, 1)
        edge = np.concatenate([[0], np.cumsum(size)[ends + np.arange(len(ends))]])
        return np.append(self.every, np.uint16(END_ID))[_places(begin, size)], edge


def _joined(pieces: pa.Array) -> str:
    """Pieces, which hold no blank, with blanks between them: much faster than a Python string of each."""
    edges = pa.array([0, len(pieces)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(edges, pieces), " ")[0].as_py()


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the elements of runs lie that begin and are as long as given."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class _LetterWords:
    """Ids of words of plain letters: the tokenizer's model alone, as its other steps leave such a word in one piece.

    Many words go to the library as one text.  A word ends with the id that has the model's suffix.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.odd = [(chr(byte), as_bytes.pre_tokenize_str(chr(0xC0 + byte - 0x80))[0][0][1]) for byte in (0x9F, 0xA0, 0xAD)]  # ß, à, í
        vocabulary, suffix = tokenizer.get_vocab(), tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    @classmethod
    def of(cls, tokenizer) -> _LetterWords | None:
        """None where the tokenizer is not seen to take such words like this."""
        if not getattr(tokenizer.model, "end_of_word_suffix", None):
            return None
        made = cls(tokenizer)
        trial = ["the", "zqxj", "na\u00efve", "abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
        sizes, ids = made(" ".join(trial))
        whole = [e.ids for e in tokenizer.encode_batch_fast(trial, add_special_tokens=False)]
        return made if [len(x) for x in whole] == sizes.tolist() and list(chain.from_iterable(whole)) == ids.tolist() else None

    def __call__(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word of a text, and all the ids."""
        text = words.lower().encode().decode("latin-1")  # a character a byte, all but a few of them those that the model has for it
        for byte, own in self.odd:
            text = text.replace(byte, own)
        parts = text.split(" ")
        texts = [" ".join(parts[k : k + 50]) for k in range(0, len(parts), 50)]
        found = []
        for k in range(0, len(texts), 20):
            found += [np.array(e.ids, np.uint16) for e in self.model.encode_batch_fast(texts[k : k + 20], add_special_tokens=False)]
        ids = np.concatenate(found)
        return np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids


def _pieces(batch: pa.RecordBatch):
    ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy())
    cuts = [0, *np.flatnonzero(np.diff(ends // PIECE_CHARS) > 0) + 1, len(ends)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


_encoders: dict[str, Encoder] = {}

BLOCK_SCHEMA = "part int, start long, n_ids long, doc_ids array<long>, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int = VOCABULARY) -> None:
    """Write the ids of ``docs`` to ``path``, in ascending doc_id order over parts and blocks.

    Missing texts are empty and have the end id alone.  Rows without doc_id
    come first; rows repeated under one doc_id follow each other, by text.
    A document of any length lies in one block.
    """

    def blocks(batches):
        # a task has one core; threads of the tokenizer would only hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if tokenizer_path not in _encoders:  # one worker process runs many tasks
            _encoders[tokenizer_path] = Encoder(Tokenizer.from_file(tokenizer_path))
        encode = _encoders[tokenizer_path]
        part, done = TaskContext.get().partitionId(), 0
        ready: list[tuple[list, list[np.ndarray]]] = []
        names, held, size = [], [], 0

        def flush():
            nonlocal done
            rows = pack_blocks([ids for _, ids in ready], vocabulary)
            starts, counts = [], []
            for _, ids in ready:
                starts.append(done)
                counts.append(sum(map(len, ids)))
                done += counts[-1]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ready), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n for n, _ in ready], pa.list_(pa.int64())),
                    pa.array(rows, pa.binary()),
                ],
                ["part", "start", "n_ids", "doc_ids", "data"],
            )
            ready.clear()
            return batch

        for batch in batches:
            for piece in _pieces(batch):
                ids, edge = encode(piece.column(1))
                for k, name in enumerate(piece.column(0).to_pylist()):
                    names.append(name)
                    held.append(ids[edge[k] : edge[k + 1]].copy())
                    size += len(held[-1])
                    if size >= BLOCK_IDS:
                        ready.append((names, held))
                        names, held, size = [], [], 0
                        if len(ready) == GROUP:
                            yield flush()
        if held:
            ready.append((names, held))
        if ready:
            yield flush()

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document.

    With ``as_bytes`` the ids are one binary value of little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row per written part
    before = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def decode(batches):
        for batch in batches:
            for low in range(0, len(batch), GROUP):
                some = batch.slice(low, GROUP)
                for k, docs in enumerate(unpack_blocks(some.column(3).to_pylist())):
                    lengths = np.array([len(d) for d in docs], np.int64)
                    start = some.column(1)[k].as_py() + np.cumsum(lengths) - lengths
                    edge, flat = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate(docs).astype("<i4")
                    if as_bytes:
                        ids = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(4 * edge.astype(np.int64)), pa.py_buffer(flat)])
                        ids = ids.cast(pa.binary())
                    else:
                        ids = pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([some.column(0)[k].as_py()] * len(docs), pa.int32()), some.column(2)[k].values, pa.array(start), pa.array(lengths), ids],
                        ["part", "doc_id", "start", "n_tokens", "ids"],
                    )

    kind = "binary" if as_bytes else "array<int>"
    rows = files.select("part", "start", "doc_ids", "data").mapInArrow(decode, f"part int, doc_id long, start long, n_tokens long, ids {kind}")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_checksums(docs: DataFrame) -> DataFrame:
    """ids_crc32 of each document's ids as little-endian unsigned 32-bit integers, in the place of the ids.

    Ids that are such bytes already need no Python.
    """
    if docs.schema["ids"].dataType == BinaryType():
        return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

    def check(batches):
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<u4")
            edge = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = docs.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
