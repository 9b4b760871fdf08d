"""Text garbled by a wrong character encoding.

A hidden Markov model labels every character with one clean state or one state for each pair of encodings (written
in one, read in the other). The clean state emits character pairs as often as the corpus does; a garbled state
emits what its pair of encodings makes of them, so no state needs examples of its own. A first pass bounds, for
all texts at once, what any garbled path could gain over the clean one (best run of the best state's log ratios);
texts whose bound is below the price of leaving the clean state are clean for certain. The others are decoded
exactly (Viterbi), and every labelled span gets its state's inverse transform.

Short texts drawn in pictures are weak evidence alone. Their chain has the picture's state hidden above the characters:
all garbled chunks of a picture share one pair of encodings, each chunk is garbled with a share that its charset tells,
and the pair is the one under which the chunks together are likeliest. Their characters are then labelled as clean or
of that state, and spans restored alike.

Defined results
* null and empty texts are clean; a text without characters beyond ASCII is clean unless question marks stand for
  letters lost in reading;
* a text is affected if any span is labelled garbled; its restored form keeps the rest of the text as it is;
* a character lost in the wrong decoding (U+FFFD) is restored where the reading encoding has one undefined byte;
  with several it is guessed from its neighbour, and the text counts as not restorable;
* rows delivered twice give equal rows; a wrong charset alone makes no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import chunks

# The characters of sound text in the corpus's languages, letters and signs of others that sound text
# may hold now and then, and pairs of encodings: written in, read in.
SOUND = "\n" + "".join(map(chr, range(0x20, 0x7F))) + "".join(map(chr, range(0x410, 0x450))) + "ЁёÄÖÜäöüß№×÷²³«»„“”…–—‐‑’‘§°±µ\u00ad¬≤ΣΔØ"
RARE = "àáâãåæçèéêëìíîïñòóôõøùúûýÿÀÁÂÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÙÚÛÝœŒšŠžŽ"
PAIRS = (
    ("utf-8", "cp1251"), ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("utf-8", "cp1252", "utf-8", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "cp866"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("koi8-r", "cp866"),
    ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("utf-8", "cp866"), ("utf-8", "koi8-r"),
)
#: The pair whose reading knew ASCII alone: every other character was lost to a question mark.
LOST = ("any", "ascii")
PAIRS += (LOST,)
#: Share of all characters that every character of SOUND and of RARE is granted, and of spaces that may look otherwise.
SOUND_SHARE, RARE_SHARE, SPACE_SHARE = 3e-5, 1e-5, 0.02
#: Spaces that wrong decodings don't make; they count as the one that does.
OTHER_SPACES = "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Log probability of characters that belong to no state.
NEUTRAL = -8.0
#: Log prices: to begin a text garbled, to turn from clean to garbled inside it, and to turn back.
BEGIN, ENTER, LEAVE = -7.0, -11.0, -3.0
#: Weight of the pair model against the single-character model, and the share kept for unseen pairs; how much
#: likelier than by chance Latin and Cyrillic letters, and Latin and foreign ones, stand side by side.
PAIR_WEIGHT, UNSEEN, MIXED, FOREIGN = 0.98, 1e-4, 1e-4, 100.0
LOOK_ALIKES = frozenset("ABCEHIKMOPTXYaceiopxyАВСЕНІКМОРТХУасеіорху")
SWAPPED = 5.0
_CYRILLIC = re.compile("[А-Яа-яЁё]")
_SIDE_BY_SIDE = re.compile("[A-Za-z\u00c0-\u00ff][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z\u00c0-\u00ff]")
#: Rows of one Viterbi block times their longest length.
BLOCK = 400_000


def _byte_table(encoding: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(None)
    return out


@lru_cache(maxsize=64)
def _reader(encoding: str) -> tuple[dict[str, int], list[int]]:
    """Byte of each character the encoding can show, and the bytes it doesn't define."""
    table = _byte_table(encoding)
    return {c: b for b, c in enumerate(table) if c is not None}, [b for b, c in enumerate(table) if c is None]


def _misread(text: str, pair: tuple[str, ...], lost: bool) -> str | None:
    """What the pair makes of a text; bytes that the reading encoding doesn't define become U+FFFD or C1 controls."""
    if pair == LOST:
        return re.sub("[^\\x00-\\x7f]", "?", text)
    for written, read in zip(pair[::2], pair[1::2]):
        try:
            raw = text.encode(written)
        except UnicodeEncodeError:
            return None
        table = _byte_table(read)
        text = "".join(table[b] if table[b] is not None else "�" if lost else chr(b) for b in raw)
    return text


def restore(text: str, pair: tuple[str, ...], pairs: np.ndarray | None = None) -> tuple[str, int]:
    """The span as it was before, and how many of its characters are lost or guessed.

    A byte lost in reading is guessed from those the reading encoding doesn't define, by the pair counts.
    """
    if pair == LOST:
        return text, text.count("?")
    lost = 0
    for written, read in reversed(list(zip(pair[::2], pair[1::2]))):
        back, undefined = _reader(read)
        out, held = "", b""
        for c in text:
            options = [back[c]] if c in back else [ord(c)] if 0x80 <= ord(c) < 0xA0 else undefined if c == "\ufffd" else []
            if len(options) > 1:
                lost += 1
                options = sorted(options, key=lambda b: -_likely(out, _decoded(held + bytes([b]), written), pairs))[:1]
            if not options:
                lost += 1
                out, held = out + "\ufffd", b""
                continue
            held += bytes(options[:1])
            got = _decoded(held, written)
            if got:
                out, held = out + got, b""
            elif written != "utf-8" or len(held) > 3:
                lost += 1
                out, held = out + "\ufffd", b""
        text = out + "\ufffd" * bool(held)
        lost += bool(held)
    return text, lost


def _decoded(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return ""


def _likely(before: str, char: str, pairs: np.ndarray | None) -> float:
    if not char or char not in _PLACE:
        return -1.0 if not char else -0.5
    return 0.0 if pairs is None else float(pairs[_PLACE.get(before[-1:], 0), _PLACE[char]])


_PLACE = {c: i for i, c in enumerate(SOUND + RARE)}


@dataclass
class Model:
    """Log probabilities of character pairs in each state; state 0 is clean."""

    lut: np.ndarray  # class of each code point below 65536
    size: int
    logs: np.ndarray  # states x (class, next class)
    best: np.ndarray  # greatest log ratio of any garbled state to the clean one
    pairs: np.ndarray  # how often sound or rare character i is followed by j

    def classes(self, points: np.ndarray) -> np.ndarray:
        return self.lut[np.minimum(points, 65535)]


def sound_classes() -> np.ndarray:
    """Class of each code point within SOUND, or len(SOUND)."""
    lut = np.full(65536, len(SOUND), dtype=np.int32)
    for i, c in enumerate(SOUND):
        lut[ord(c)] = i
    return lut


def build(counts: np.ndarray) -> Model:
    """counts: how often sound character i is followed by j, over the corpus."""
    letters = SOUND + RARE
    n = len(letters)
    padded = np.zeros((n, n))
    padded[: len(SOUND), : len(SOUND)] = counts
    mass = max(counts.sum(), 1.0)
    single = padded.sum(0) / mass + np.where(np.arange(n) < len(SOUND), SOUND_SHARE, RARE_SHARE)
    single /= single.sum()
    latin = np.array([c.isalpha() and not _CYRILLIC.match(c) for c in letters])
    cyrillic = np.array([bool(_CYRILLIC.match(c)) for c in letters])
    rare = np.arange(n) >= len(SOUND)
    likely = np.ones((n, n))
    likely[np.ix_(latin, cyrillic)] = likely[np.ix_(cyrillic, latin)] = MIXED
    likely[np.ix_(latin, rare)] = likely[np.ix_(rare, latin)] = FOREIGN  # a foreign letter stands among Latin ones
    weight = np.maximum(padded.sum(1, keepdims=True), single[:, None] * mass)
    chance = (1 - PAIR_WEIGHT) * weight * single[None, :]
    counts = PAIR_WEIGHT * padded + chance * likely
    # in sound text a letter may have been replaced by one of another alphabet that looks like it
    alike = np.array([c in LOOK_ALIKES for c in letters])
    swapped = np.where((latin[:, None] & (cyrillic & alike)[None, :]) | ((cyrillic & alike)[:, None] & latin[None, :]) | (cyrillic[:, None] & (latin & alike)[None, :]) | ((latin & alike)[:, None] & cyrillic[None, :]), SWAPPED, likely)
    clean_counts = PAIR_WEIGHT * padded + chance * swapped
    # per state and character: how it may look, and how often so
    forms: list[list[list[tuple[str, float]]]] = [[[(c, 1.0)] for c in letters]]
    forms[0][letters.index(" ")] = [(" ", 1 - SPACE_SHARE), ("\u00a0", SPACE_SHARE)]
    for pair in PAIRS:
        own = []
        for c in letters:
            seen = sorted(x for x in {_misread(c, pair, lost) for lost in (True, False)} - {None} if x)
            own.append([(x, 1 / len(seen)) for x in seen])
        forms.append(own)
    alphabet = sorted({c for state in forms for looks in state for look, _ in looks for c in look})
    size = len(alphabet) + 1
    at = {c: i for i, c in enumerate(alphabet)}
    lut = np.full(65536, size - 1, dtype=np.int32)
    for c, i in at.items():
        if ord(c) < 65536:
            lut[ord(c)] = i
    for c in OTHER_SPACES:
        lut[ord(c)] = at["\u00a0"]
    logs = []
    single = counts.sum(0)
    for number, state in enumerate(forms):
        own = counts if number else clean_counts
        table = np.zeros((size, size))
        first = np.zeros((n, size))
        last = np.zeros((n, size))
        for i, looks in enumerate(state):
            for look, share in looks:
                first[i, at[look[0]]] += share
                last[i, at[look[-1]]] += share
                for a, b in zip(look, look[1:]):
                    table[at[a], at[b]] += share * single[i]
        table += last.T @ own @ first
        total = table.sum(1, keepdims=True)
        pairwise = np.where(total > 0, table / np.maximum(total, 1e-9), 1 / size)
        logs.append(np.log((1 - UNSEEN) * pairwise + UNSEEN / size))
    stacked = np.stack(logs).astype(np.float32)
    ascii_only = np.array([c < "\x80" for c in alphabet] + [False])
    both = ascii_only[:, None] & ascii_only[None, :]
    told = both.copy()
    told[at["?"], :] = told[:, at["?"]] = False
    lost = 1 + PAIRS.index(LOST)
    for number in range(1, len(stacked)):  # plain ASCII tells nothing about the encoding, but for what stands for lost letters,
        same = told if number == lost else both
        stacked[number, same] = stacked[0, same]
    stacked[:, -1, :] = stacked[:, :, -1] = NEUTRAL  # nor does a character that no wrong decoding makes
    best = (stacked[1:].max(0) - stacked[0]).astype(np.float32)
    return Model(lut, size, stacked.reshape(len(stacked), -1), best.reshape(-1), counts.astype(np.float32))


def count_pairs(texts: list[str], lut: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring characters in texts of sound characters without capitals inside words."""
    n = len(SOUND)
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = lut[np.minimum(points, 65535)]
    odd = (classes == n) | _odd_case(points)
    odd[1:] |= (points[1:] == 0x3F) & (points[:-1] == 0x3F)  # lost letters
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    sound = ~np.maximum.reduceat(odd[:-1], start)
    keep = np.repeat(sound, lengths + 1)  # steps from each text's opening boundary to its last character
    return np.bincount((classes[:-1] * n + classes[1:])[keep], minlength=n * n) if keep.any() else np.zeros(n * n, dtype=np.int64)


def _odd_case(points: np.ndarray) -> np.ndarray:
    """A capital Cyrillic letter right after a small letter."""
    capital = ((points >= 0x410) & (points <= 0x42F)) | (points == 0x401)
    small = ((points >= 0x430) & (points <= 0x44F)) | ((points >= 0x61) & (points <= 0x7A))
    odd = np.zeros(len(points), dtype=bool)
    odd[1:] = capital[1:] & small[:-1]
    return odd


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How often sound character i is followed by j in the texts (one column ``text``). Its size depends on SOUND alone."""
    lut = sound_classes()
    n = len(SOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for _, own in chunks(batch, "text"):
                total += count_pairs(own, lut)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    rows = texts.select("text").where(F.length("text") > 0).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most len(SOUND) ** 2
    counts = np.zeros(n * n)
    for r in rows:
        counts[r.pair] = r.n
    return counts.reshape(n, n)


def train(texts: DataFrame) -> Model:
    """The model of a corpus; texts: one column ``text``. Its size depends on the alphabets alone."""
    return build(pair_counts(texts))


def suspects(texts: list[str], model: Model) -> np.ndarray:
    """Which texts can gain by any garbled path."""
    if not texts:
        return np.zeros(0, dtype=bool)
    joined = ("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, dtype=np.uint32)
    classes = model.classes(points).astype(np.int64)
    gain = model.best[classes[:-1] * model.size + classes[1:]].astype(np.float64)
    # step i leads from character i to i + 1; text t's steps run from its opening boundary to its closing one,
    # and both neighbours use the boundary between them, which only widens the bound
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    total = np.concatenate([[0.0], np.cumsum(gain)])
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    apart = 1e7 * owner
    lowest = np.minimum.accumulate(total[: len(owner)] - apart) + apart
    rise = total[1 : len(owner) + 1] - lowest
    return np.maximum.reduceat(rise, start) > -BEGIN


def label(texts: list[str], model: Model) -> list[np.ndarray]:
    """State of each character of each text, by Viterbi, in blocks of texts of like length."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    states = len(model.logs)
    at = 0
    while at < len(order):
        rows = 1
        while at + rows < len(order) and (rows + 1) * (len(texts[order[at + rows]]) + 1) <= BLOCK:
            rows += 1
        block = order[at : at + rows]
        at += rows
        longest = max(len(texts[i]) for i in block)
        grid = np.full((rows, longest + 2), model.lut[10], dtype=np.int64)
        lengths = np.array([len(texts[i]) for i in block])
        for r, i in enumerate(block):
            grid[r, 1 : lengths[r] + 1] = model.classes(np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        value = np.full((rows, states), BEGIN)
        value[:, 0] = 0
        back = np.zeros((longest + 1, rows, states), dtype=np.int8)
        every = np.arange(rows)
        final = np.zeros((rows, states))
        for t in range(1, longest + 2):
            if t > 1:
                dirty = value[:, 1:].argmax(1) + 1
                dirty_value = value[every, dirty]
                leave = dirty_value + LEAVE > value[:, 0]
                enter_from = np.where(value[:, 0] >= dirty_value, 0, dirty).astype(np.int8)
                enter_value = np.maximum(value[:, 0], dirty_value) + ENTER
                move = enter_value[:, None] > value[:, 1:]
                back[t - 1, :, 1:] = np.where(move, enter_from[:, None], np.arange(1, states, dtype=np.int8)[None, :])
                back[t - 1, :, 0] = np.where(leave, dirty, 0)
                clean = np.maximum(value[:, 0], dirty_value + LEAVE)
                value[:, 1:] = np.maximum(value[:, 1:], enter_value[:, None])
                value[:, 0] = clean
            closing = t == lengths + 1
            step = model.logs[:, grid[:, t - 1] * model.size + grid[:, t]].T
            if closing.any():  # the closing boundary belongs to the last character's state
                final[closing] = (value + step)[closing] if t == 1 else (_undo(value, back[t - 1], step))[closing]
            value = value + step
        # follow the best path back from each text's end
        paths = np.zeros((rows, longest + 1), dtype=np.int8)
        now = np.zeros(rows, dtype=np.int64)
        for t in range(longest, 0, -1):
            ends = lengths == t
            now = np.where(ends, final.argmax(1), now)
            paths[:, t] = now
            now = back[t - 1, every, now].astype(np.int64) if t > 1 else now
        for r, i in enumerate(block):
            out[i] = paths[r, 1 : lengths[r] + 1]
    return out


def _undo(value: np.ndarray, back: np.ndarray, step: np.ndarray) -> np.ndarray:
    """At the closing boundary no change of state is taken: only states that stay count."""
    stay = back == np.arange(value.shape[1], dtype=np.int8)[None, :]
    return np.where(stay, value, -1e30) + step


#: What a picture's encoding pair must gain over the clean state, and how often a picture's chunks are garbled then:
#: by the charset of their font (204 is Cyrillic, 0 and 1 leave the reading open), and where it says nothing.
PICTURE_MARGIN, CHUNK_GARBLED = 4.0, 0.7
GARBLED_BY_CHARSET = {204: 0.6, 0: 0.75, 1: 0.85}


def garbled_share(charsets: list) -> np.ndarray:
    return np.array([GARBLED_BY_CHARSET.get(c, CHUNK_GARBLED) for c in charsets])


def _blocks(texts: list[str], model: Model) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of like length: their indices, a grid of classes between boundaries, and their lengths."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        rows = 1
        while at + rows < len(order) and (rows + 1) * (len(texts[order[at + rows]]) + 1) <= BLOCK:
            rows += 1
        block = order[at : at + rows]
        at += rows
        lengths = np.array([len(texts[i]) for i in block])
        grid = np.full((rows, int(lengths.max()) + 2), model.lut[10], dtype=np.int64)
        for r, i in enumerate(block):
            grid[r, 1 : lengths[r] + 1] = model.classes(np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        yield block, grid, lengths


def evidence(texts: list[str], charsets: list, model: Model) -> np.ndarray:
    """For each chunk and garbled state: the log of how much likelier the chunk is in a picture of that state.

    In such a picture a chunk is garbled with the share its charset tells, and clean otherwise.
    """
    states = len(model.logs)
    out = np.zeros((len(texts), states - 1))
    share = garbled_share(charsets)[:, None]
    for block, grid, lengths in _blocks(texts, model):
        steps = model.logs[:, grid[:, :-1] * model.size + grid[:, 1:]]
        steps[:, np.arange(grid.shape[1] - 1)[None, :] > lengths[:, None]] = 0
        gain = steps.sum(2).T.astype(float)
        out[block] = gain[:, 1:] - gain[:, :1]
    return np.logaddexp(np.log(share) + out, np.log(1 - share))


def label_with(texts: list[str], pairs: list[int], charsets: list, model: Model) -> list[np.ndarray]:
    """State of each character by Viterbi, where each text may only be clean or in its picture's state; inside a
    chunk a change is as rare either way."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(texts)
    share = garbled_share(charsets)
    for block, grid, lengths in _blocks(texts, model):
        state = np.array([pairs[i] for i in block])
        longest = int(lengths.max())
        value = np.stack([np.log(1 - share[block]), np.log(share[block])], 1)
        back = np.zeros((longest + 2, len(block), 2), dtype=np.int8)
        final = np.zeros((len(block), 2))
        for t in range(1, longest + 2):
            before = grid[:, t - 1] * model.size + grid[:, t]
            step = np.stack([model.logs[0, before], model.logs[state, before]], 1)
            closing = t == lengths + 1  # the closing boundary belongs to the last character's state
            final[closing] = (value + step)[closing]
            if t > 1:
                leave, enter = value[:, 1] + ENTER > value[:, 0], value[:, 0] + ENTER > value[:, 1]
                back[t, :, 0], back[t, :, 1] = leave, ~enter
                value = np.stack([np.maximum(value[:, 0], value[:, 1] + ENTER), np.maximum(value[:, 1], value[:, 0] + ENTER)], 1)
            value = value + step
        every, now = np.arange(len(block)), final.argmax(1)
        path = np.zeros((len(block), longest + 2), dtype=np.int8)
        for t in range(longest, 0, -1):
            now = np.where(lengths == t, final.argmax(1), now)
            path[:, t] = now
            if t > 1:
                now = back[t, every, now].astype(np.int64)
        for r, i in enumerate(block):
            out[i] = np.where(path[r, 1 : lengths[r] + 1] > 0, state[r], 0).astype(np.int8)
    return out


def spans(states: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, state) of each garbled run; runs that touch are one, of the longest one's state."""
    if not states.any():
        return []
    edges = np.flatnonzero(np.diff(states)) + 1
    out: list[list[int]] = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(states)]):
        if not states[a]:
            continue
        if out and out[-1][1] == a:
            out[-1] = [out[-1][0], b, int(states[a]) if b - a > out[-1][3] else out[-1][2], max(b - a, out[-1][3])]
        else:
            out.append([a, b, int(states[a]), b - a])
    return [(a, b, k) for a, b, k, _ in out]


def fix(text: str, states: np.ndarray, model: Model) -> tuple[str, str, bool] | None:
    """Restored text, encoding pairs and whether all of it is certain; None for a clean text."""
    parts, names, whole, at = [], [], True, 0
    for a, b, k in spans(states):
        pair = PAIRS[k - 1]
        letters = sum(c.isalpha() for c in text[a:b])
        if text[a:b].count("?") <= letters if pair == LOST else text[a:b].isascii():
            continue  # a few question marks behind words are a writer's own
        got, lost = restore(text[a:b], pair, model.pairs)
        options = [(_loss(got, lost), 0, got, pair, lost)]
        for n, other in enumerate(PAIRS if options[0][0] and pair != LOST else ()):  # kindred pairs may explain it with less loss
            again, less = restore(text[a:b], other, model.pairs)
            options.append((_loss(again, less), n + 1, again, other, less))
        _, _, got, pair, lost = min(options)
        parts += [text[at:a], got]
        names.append(">".join(pair))
        whole &= not lost
        at = b
    if not names:
        return None
    return "".join(parts) + text[at:], "; ".join(dict.fromkeys(names)), whole


def _loss(text: str, lost: int) -> int:
    """Characters lost, unknown, foreign, or side by side with another alphabet."""
    return lost + sum(2 * (c not in _KNOWN) + (c in _FOREIGN) for c in text) + 2 * len(_SIDE_BY_SIDE.findall(text))


_FOREIGN = frozenset(RARE)
_KNOWN = frozenset(SOUND + RARE + "\u00a0")


_SCHEMA = "record_table string, owner_id string, item_id string, text string, restored string, pairs string, restorable boolean"


def _emit(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    """out: row, item id, text, restored, pairs, restorable."""
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    of = pa.array(columns[0], pa.int64())
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("record_table").take(of), batch.column("owner_id").take(of), *[pa.array(c, pa.string()) for c in columns[1:5]], pa.array(columns[5], pa.bool_())], names)


def garbled_units(units: DataFrame, model: Model) -> DataFrame:
    """record_table, owner_id, item_id, text, restored, pairs and restorable of every affected unit."""
    shared = units.sparkSession.sparkContext.broadcast(model)  # its size depends on the alphabets alone
    # plain ASCII without question marks in a row can't be the result of a wrong decoding, and needn't leave the JVM
    rows = units.select(F.lit("document_units").alias("record_table"), F.col("document_id").alias("owner_id"), F.col("unit_id").alias("item_id"), "text").where(F.col("text").rlike("[^\\x00-\\x7F]|\\?\\?"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            hit: list[tuple[int, str]] = []
            at = 0
            for part, values in chunks(batch, "text"):
                hit += [(at + i, values[i]) for i in np.flatnonzero(suspects(values, own)).tolist()]
                at += part.num_rows
            ids = batch.column("item_id")
            yield _emit(batch, [(i, ids[i].as_py(), t, *f) for (i, t), s in zip(hit, label([t for _, t in hit], own), strict=True) if (f := fix(t, s, own))])

    return rows.mapInArrow(run, _SCHEMA)


def garbled_chunks(chunks_: DataFrame, model: Model) -> DataFrame:
    """The same for every affected chunk of pictures' text.

    All garbled chunks of a picture share one state. Each chunk's evidence for each state is summed over its picture
    by a partial aggregate, so no picture is gathered in one place; chunks of pictures with a state are then labelled
    character by character.
    """
    shared = chunks_.sparkSession.sparkContext.broadcast(model)  # its size depends on the alphabets alone
    keys = ["document_id", "asset_id", "chunk_ref"]
    rows = drawn(chunks_).select(*keys, "text", "charset").distinct()
    # only text beyond ASCII tells anything, and only it can be garbled; a chunk without a picture is one of its own
    rows = rows.where(F.col("text").rlike("[^\\x00-\\x7F]|\\?")).withColumn("picture", F.coalesce("asset_id", F.concat(F.lit("\0"), "chunk_ref")))
    n = len(PAIRS)
    names = [f"s{k}" for k in range(1, n + 1)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                got = evidence(texts, part.column("charset").to_pylist(), own) if texts else np.zeros((0, n))
                yield pa.RecordBatch.from_arrays([part.column("document_id"), part.column("picture"), *[pa.array(c) for c in got.T]], ["document_id", "picture", *names])

    weighed = rows.select("document_id", "picture", "text", "charset").mapInArrow(weigh, "document_id string, picture string, " + ", ".join(f"{c} double" for c in names))
    total = weighed.groupBy("document_id", "picture").agg(*[F.sum(c).alias(c) for c in names])
    best = F.greatest(*names)
    first = F.array_position(F.array(*names), best).cast("int")
    told = total.where(best >= PICTURE_MARGIN).select(F.col("document_id").alias("d"), F.col("picture").alias("p"), first.alias("state"))
    suspected = rows.join(told, rows.document_id.eqNullSafe(told.d) & (rows.picture == told.p)).select(F.lit("wmf_text_chunks").alias("record_table"), F.col("document_id").alias("owner_id"), F.col("chunk_ref").alias("item_id"), "text", "charset", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids = part.column("item_id").to_pylist()
                labels = label_with(texts, part.column("state").to_pylist(), part.column("charset").to_pylist(), own)
                yield _emit(part, [(i, ids[i], t, *f) for i, (t, s) in enumerate(zip(texts, labels, strict=True)) if (f := fix(t, s, own))])

    return suspected.mapInArrow(run, _SCHEMA)


def drawn(chunks_: DataFrame) -> DataFrame:
    """Chunks of letters: without those in a symbol font."""
    return chunks_.where((F.length("text") > 0) & ~F.coalesce(F.col("charset").cast("string") == "2", F.lit(False)) & ~F.coalesce(F.col("face") == "Symbol", F.lit(False)))


def repaired(units: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Every affected record of both tables with its restored text.

    The units' model is trained on their texts; the chunks' one on what is drawn and on the units, at equal weight, since
    pictures hold labels and running text.
    """
    prose, labels = pair_counts(units), pair_counts(drawn(chunks_))
    return garbled_units(units, build(prose)).unionByName(garbled_chunks(chunks_, build(blend(prose, labels))))


def blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of both at equal weight."""
    mass = max(a.sum(), b.sum())
    return sum((x * (mass / x.sum()) for x in (a, b) if x.sum() > 0), np.zeros_like(a))
