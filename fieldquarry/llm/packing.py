"""Best-fit packing of token pieces into sequences by bin completion.

Documents become token ids plus an end id; only those longer than a sequence are cut. The packer sees
only how many pieces there are of each length (at most `capacity` numbers, whatever the corpus), so
bin completion runs on the driver: the best-fit decreasing plan is the first incumbent; around the
largest length left, fillings that no further piece fits and no larger piece improves are made, and a
bin's waste prunes against the incumbent. Three searches share this: branching from the root; a dive
whose fillings waste least in prices, which the relaxation of the pieces still left gives (waste in
tokens alone uses small pieces up too early), and which branches on the last pieces; and completing
groups of badly filled bins anew. All stop at the lower bound (total length, pieces above half a bin,
or the prices) or at counted budgets (about 15 s where best-fit misses the bound, nothing where it
meets it). The result never has more bins than best-fit; it is optimal where it meets the bound. Pieces then find
their place by rank within their length: the rank among their task's pieces plus the pieces of the
tasks before, so only counts by length and task are shuffled, and a length that a third of all pieces
share stays where its pieces are.

Defined cases: null text is empty; an empty document is the end id alone; repeated rows are packed
one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.llm.common import give_back, joined, runs_of, small_batches, store, text_slices, tidy, worker_kept

CAPACITY, END_ID = 4096, 1
#: Search steps for one filling, fillings kept for one bin, and bins tried after the first step back.
FILL_STEPS, FILLINGS, RETRIES = 2000, 4, 2000
#: Classes of lengths that a relaxation tells apart, its steps a class, the price above 1 that it may leave, and relaxations of one dive.
CLASSES, RELAX_STEPS, RELAX_GAP, TURNS = 160, 30, 1e-6, 40
#: Pieces that are left to branching alone; groups of bins completed anew, bins in one, and bins tried after its first step back.
TAIL, REPAIRS, REPAIR_BINS, REPAIR_TRIES = 60, 300, 8, 60
#: Bytes of a worker's cache; units encoded and bytes of text taken at once; rows of the table of ranks that may be broadcast.
CACHE_BYTES, ENCODE_WORDS, SLICE_TEXT, BROADCAST_ROWS = 16 << 20, 4000, 2 << 20, 400_000


# ---- bin completion -----------------------------------------------------------------------------
def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram, as patterns and how many bins use each: the first incumbent."""
    room: dict[int, dict[tuple, int]] = {}  # free space -> patterns that leave it, and their bins
    spaces: list[int] = []
    full: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def add(space: int, pattern: tuple, n: int) -> None:
        if not n:
            return
        if not space:
            full.append((pattern, n))
            return
        if space not in room:
            insort(spaces, space)
            room[space] = {}
        room[space][pattern] = room[space].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (i := bisect_left(spaces, length)) < len(spaces):
            space = spaces[i]
            pattern, bins = room[space].popitem()
            if bins > left:
                room[space][pattern] = bins - left
            if not room[space]:
                del room[space], spaces[i]
            n = min(left, bins)
            left -= n
            times = pattern[-1][1] if pattern[-1][0] == length else 0
            add(space - length, (*(pattern[:-1] if times else pattern), (length, times + 1)), n)
        most = capacity // length
        bins, rest = divmod(left, most)
        add(capacity - most * length, ((length, most),), bins)
        add(capacity - rest * length, ((length, rest),), int(rest > 0))
    return [*full, *(own for patterns in room.values() for own in patterns.items())]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound: total length, and pieces above half a bin that cannot share one."""
    total = -(-sum(k * v for k, v in counts.items()) // capacity)
    return max(total, sum(v for k, v in counts.items() if 2 * k > capacity))


def fillings(lengths: list[int], counts: dict[int, int], room: int, steps: int, keep: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of room: (waste, ((length, times), ...)), least waste first.

    No further piece fits them, and none of their pieces could make way for a larger one that is left.
    Every multiple of a length is tried, larger lengths and multiples first; the search ends with the
    first filling that wastes nothing.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    worst = room + 1
    used = [0]

    def dominated(left: int, chosen: list[tuple[int, int]]) -> bool:
        """Whether a piece could make way for a larger one that is left."""
        own = dict(chosen)
        return any(counts[b] > own.get(b, 0) for a in own for b in lengths[bisect_right(lengths, a) : bisect_right(lengths, a + left)])

    def go(i: int, left: int, spare: int, chosen: list[tuple[int, int]]) -> bool:
        """i: only lengths[:i] may follow; spare: least length passed over with pieces left; True once nothing better can be found."""
        nonlocal worst
        used[0] += 1
        i = min(i, bisect_right(lengths, left))
        if i == 0 or used[0] > steps:
            if (left < spare or not found) and (left < worst or len(found) < keep) and not dominated(left, chosen):
                found.append((left, tuple(chosen)))
                found.sort(key=lambda f: f[0])
                del found[keep:]
                worst = found[-1][0] if len(found) == keep else room + 1
            return left == 0 or used[0] > steps
        for j in range(i - 1, -1, -1):
            length = lengths[j]
            most = min(counts[length], left // length)
            passed = lengths[j + 1] if j + 1 < i else spare
            for n in range(most, 0 if j else most - 1, -1):  # below the least length nothing follows
                if go(j, left - n * length, min(passed, length) if n < counts[length] else passed, [*chosen, (length, n)]):
                    return True
            if 2 * length <= left and len(found) == keep and found[0][0] <= 1:
                return True
        return False

    go(len(lengths), room, room + 1, [])
    return found or [(room, ())]


def branch(counts: dict[int, int], capacity: int, goal: int, best: list, tries_allowed: int) -> list:
    """Bin completion from the root: the fewest bins found, best (the incumbent) if none are fewer.

    Around the largest length left its fillings are tried, least waste first, each as often as counts
    allow and then once; a bin whose waste leaves no way to fewer bins than the incumbent's is pruned.
    """
    best_bins = sum(n for _, n in best)
    left = dict(counts)
    lengths = sorted(left)
    stack: list[list] = []  # [top, options, next option, applied pattern, times, waste of it]
    wasted, tries, first = 0, 0, True
    size = sum(k * v for k, v in counts.items())

    def put(pattern, times: int) -> None:
        for length, n in pattern:
            left[length] -= n * times
            if not left[length]:
                lengths.pop(bisect_right(lengths, length) - 1)

    def take_back(pattern, times: int) -> None:
        for length, n in pattern:
            if not left[length]:
                lengths.insert(bisect_right(lengths, length), length)
            left[length] += n * times

    down = True
    while True:
        if down and lengths:
            top = lengths[-1]
            left[top] -= 1
            inner = lengths if left[top] else lengths[:-1]
            options = [(w, f, most) for w, f in fillings(inner, left, capacity - top, FILL_STEPS, FILLINGS) for most in (True, False)]
            left[top] += 1
            stack.append([top, options, 0, None, 0, 0])
        elif down:
            bins = sum(f[4] for f in stack)
            if bins < best_bins:
                best, best_bins = [(f[3], f[4]) for f in stack], bins
            if best_bins <= goal:
                break
            down = False
        if not stack:
            break
        frame = stack[-1]
        if frame[3] is not None:
            take_back(frame[3], frame[4])
            wasted -= frame[5]
            frame[3] = None
        top, options, i = frame[:3]
        first &= down
        tries += not first
        if tries > tries_allowed:
            break
        if i >= len(options):
            stack.pop()
            down = False
            continue
        waste, filling, most = options[i]
        frame[2] += 1
        merged = dict(filling)
        merged[top] = merged.get(top, 0) + 1
        pattern = tuple(sorted(merged.items(), reverse=True))
        times = min(left[length] // n for length, n in pattern)
        if not most and times == 1:
            down = False
            continue
        times = times if most else 1
        if wasted + waste * times > (best_bins - 1) * capacity - size:
            down = False
            continue
        put(pattern, times)
        frame[3:] = [pattern, times, waste * times]
        wasted += waste * times
        down = True
    return best


# ---- waste in prices ----------------------------------------------------------------------------
def dearest(sizes: np.ndarray, prices: np.ndarray, caps: np.ndarray, capacity: int, pattern: bool = True) -> tuple[float, np.ndarray]:
    """The greatest price that one bin can hold, at most caps of a size, and (if asked for) how many of each size it then holds."""
    value, took = np.zeros(capacity + 1), []
    for i in np.flatnonzero(prices > 1e-12):
        size, most, chunk = int(sizes[i]), int(min(caps[i], capacity // sizes[i])), 1
        while most > 0:
            n = min(chunk, most)
            with_it = value[: capacity + 1 - n * size] + n * prices[i]
            better = with_it > value[n * size :] + 1e-12
            value[n * size :] = np.where(better, with_it, value[n * size :])
            if pattern:
                took.append((i, n, better))
            most, chunk = most - n, 2 * chunk
    held, room = np.zeros(len(sizes)), capacity
    for i, n, better in reversed(took):
        if room >= n * sizes[i] and better[room - n * sizes[i]]:
            held[i] += n
            room -= n * int(sizes[i])
    return float(value[capacity]), held


def relax(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prices by size, fillings as columns, times of each): the relaxation that may use a filling in part.

    A bin holds pieces worth 1 at most, so 1 less its price is what a filling wastes. Fillings enter
    one at a time, always the one worth most at the prices so far.
    """
    m = len(sizes)
    most = np.minimum(capacity // sizes, need).astype(float)
    columns, cost = np.diag(most), np.ones(m)
    inverse, times = np.diag(1 / most), need / most
    for step in range(RELAX_STEPS * m):
        prices = cost @ inverse
        i = int(prices.argmin())
        if prices[i] < -1e-9:  # more of a size than needed may be held
            entering, price = -np.eye(m)[i], 0.0
        else:
            worth, entering = dearest(sizes, prices, need, capacity)
            if worth <= 1 + RELAX_GAP:
                break
            price = 1.0
        way = inverse @ entering
        ratio = np.where(way > 1e-8, times / np.maximum(way, 1e-8), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], cost[out] = entering, price
        if step % 64 == 63:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
        times = np.maximum(inverse @ need, 0)
    return cost @ inverse, columns[:, cost > 0], times[cost > 0]


def priced_bound(counts: dict[int, int], capacity: int, at: np.ndarray, prices: np.ndarray) -> int:
    """Lower bound: pieces at prices of which no bin can hold more than its share (a dual-feasible function)."""
    lengths = np.array(sorted(counts))
    own = np.interp(lengths, at, np.maximum(prices, 0))
    n = np.array([counts[int(k)] for k in lengths])
    worth = dearest(lengths, own, n, capacity, pattern=False)[0]
    return int(np.ceil((own * n).sum() / worth - 1e-6)) if worth > 0 else 0


class Pieces:
    """Pieces left by length, and bins made from them around their largest."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left, self.capacity, self.lengths = dict(counts), capacity, sorted(counts)
        self.bins: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def largest(self, limit: int, used: dict[int, int]) -> int:
        """The largest length up to limit of which more are left than used; 0 if there is none."""
        for i in range(bisect_right(self.lengths, limit) - 1, -1, -1):
            if self.left[self.lengths[i]] > used.get(self.lengths[i], 0):
                return self.lengths[i]
        return 0

    def fill(self, limits: list[int], times: int) -> int:
        """Make up to times bins: for each limit the largest piece up to it, made undominated; the bins made."""
        used: dict[int, int] = {}
        room = self.capacity
        for limit in limits:
            if length := self.largest(min(limit, room), used):
                used[length] = used.get(length, 0) + 1
                room -= length
        while room:  # a larger piece in place of one that is held, or one more
            swaps = [(b - a, a, b) for a in (*used, 0) if (b := self.largest(a + room, used)) > a]
            if not swaps:
                break
            gain, a, b = max(swaps)
            if a:
                used[a] -= 1
                if not used[a]:
                    del used[a]
            used[b] = used.get(b, 0) + 1
            room -= gain
        if not used:
            return 0
        times = min(times, *(self.left[k] // n for k, n in used.items()))
        self.bins.append((tuple(sorted(used.items(), reverse=True)), times))
        for k, n in used.items():
            self.left[k] -= n * times
            if not self.left[k]:
                self.lengths.pop(bisect_right(self.lengths, k) - 1)
        return times


def dive(counts: dict[int, int], capacity: int, goal: int) -> tuple[list, int]:
    """(plan, lower bound): bins filled as the relaxation of what is left tells, largest pieces first; the last ones by `branch`.

    Each turn relaxes what is left (lengths in at most CLASSES classes, taken at their largest) and
    makes the bins that it wants whole, or else those it wants most, so that prices follow the pieces.
    """
    pieces, bound = Pieces(counts, capacity), goal
    for _ in range(TURNS):
        if sum(pieces.left.values()) <= TAIL:
            break
        classes = np.array_split(np.array(pieces.lengths), min(CLASSES, len(pieces.lengths)))
        at = np.array([c[-1] for c in classes])
        need = np.array([sum(pieces.left[int(k)] for k in c) for c in classes], float)
        prices, columns, times = relax(at, need, capacity)
        if not pieces.bins:
            bound = max(goal, priced_bound(counts, capacity, at, prices))
        whole = np.floor(times + 1e-6)
        if whole.sum() * 4 < times.sum():
            whole = np.maximum(whole, times >= min(0.6, times.max()))
        for j in sorted(np.flatnonzero(whole), key=lambda j: tuple(columns[::-1, j]), reverse=True):
            limits = [int(at[i]) for i in np.flatnonzero(columns[:, j])[::-1] for _ in range(int(columns[i, j]))]
            todo = int(whole[j])
            while todo and (made := pieces.fill(limits, todo)):
                todo -= made
    rest = {k: v for k, v in pieces.left.items() if v}
    plan = pieces.bins + (branch(rest, capacity, least_bins(rest, capacity), best_fit(rest, capacity), RETRIES) if rest else [])
    return plan, bound


def recomplete(plan: list, capacity: int, goal: int) -> list:
    """plan with groups of bins, the worst filled and others by lot, completed anew wherever that saves a bin."""
    rng = np.random.default_rng(7)
    plan = [list(p) for p in plan]
    for _ in range(REPAIRS):
        total = sum(n for _, n in plan)
        if total <= goal:
            break
        waste = np.array([capacity - sum(k * n for k, n in p) for p, _ in plan], float)
        order = np.argsort(-(waste + rng.random(len(plan)) * (waste.mean() + 1)), kind="stable")
        picked = [*order[: REPAIR_BINS // 2], *rng.permutation(order[REPAIR_BINS // 2 :])[: REPAIR_BINS - REPAIR_BINS // 2]]
        if sum(waste[i] for i in picked) < capacity:
            continue
        rest: dict[int, int] = {}
        for i in picked:
            for k, n in plan[i][0]:
                rest[k] = rest.get(k, 0) + n
        own = [(plan[i][0], 1) for i in picked]
        made = branch(rest, capacity, len(own) - 1, own, REPAIR_TRIES)
        if sum(n for _, n in made) < len(own):
            for i in picked:
                plan[i][1] -= 1
            plan = [p for p in plan if p[1]] + [list(p) for p in made]
    return [(p, n) for p, n in plan]


def complete_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int, int]:
    """(patterns, bins, lower bound); a pattern is ((length, times), ...) and how many bins use it."""
    goal, best = least_bins(counts, capacity), best_fit(counts, capacity)
    if sum(n for _, n in best) > goal:
        best = branch(counts, capacity, goal, best, RETRIES)
    if sum(n for _, n in best) > goal:
        plan, goal = dive(counts, capacity, goal)
        best = min(best, plan, key=lambda p: sum(n for _, n in p))
        best = recomplete(best, capacity, goal)
    return best, sum(n for _, n in best), goal


# ---- tokens -------------------------------------------------------------------------------------
#: Letters, single digits and other runs, which the tokenizer never joins.
PARTS = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+")
ASCII_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
# Fixed value: the split pattern of the tokenizer for which words can be encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes: white space, letter, digit, other ASCII, and what keeps its word whole (apostrophes, non-ASCII).
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
_KIND = np.array([SPACE if c in b" \t\n\v\f\r" else WHOLE if c > 127 or c == 39 else DIGIT if 48 <= c < 58 else LETTER if chr(c).isalpha() else OTHER for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)


def word_parts(word: str) -> list[str]:
    """word in parts that encode to its ids in turn; whole where its parts could touch.

    Apostrophes (contractions), special tokens, text that normalisation would change and the one
    letter whose lower case ends in a mark keep a word whole.
    """
    if "'" in word or "<|" in word:
        return [word]
    if word.isascii():
        return ASCII_PARTS.findall(word.lower())
    if "\u0130" in word or not unicodedata.is_normalized("NFC", word):
        return [word]
    return PARTS.findall(word)


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts in turn, units of each text), by classes of bytes.

    A unit is a lower-case part of a plain ASCII word, or any other word as it stands.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    tags = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token
    kind[tags] = WHOLE
    solid = kind != SPACE
    begins = np.append(True, ~solid[:-1]) & solid if len(data) else solid
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = solid[inner]
    through = np.concatenate([np.zeros(1, np.int32), np.cumsum(solid, dtype=np.int32)])[offsets]
    data, kind, begins = data[solid], kind[solid], begins[solid]
    word = np.cumsum(begins, dtype=np.int32) - 1
    whole = np.zeros(int(word[-1]) + 1 if len(word) else 0, bool)
    whole[word[kind == WHOLE]] = True
    whole = whole[word]
    begins[1:] |= ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    starts = np.flatnonzero(begins)
    made = np.where(whole, data, _LOWER[data])
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(made))
    return units, np.diff(np.searchsorted(starts, through))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[starts:starts + sizes] of codes, one after the other (32-bit positions: of a slice)."""
    per = sizes[codes]
    ends = np.cumsum(per, dtype=np.int32)
    at = np.repeat(starts[codes] - ends + per, per)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class WordIds:
    """Ids of units, each found once by the tokenizer while it stays in a cache bounded by bytes.

    Words never share a token across white space, nor parts of a word (`word_parts`) among each other,
    so the ids of a text are those of its units in turn. The cache is an Arrow column, not a dict.
    """

    def __init__(self, model):
        self.model, self.bare = model, type(model)(model.model)
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    @staticmethod
    def fits(model) -> bool:
        """Whether a tokenizer drops white space and splits as word_parts does."""
        made = json.loads(model.to_str())
        names = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return names == ["NFC", "Replace", "Lowercase"] and SPLIT in splits

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each part). Of printable ASCII normalisation only changes case: the bare model encodes that."""
        sizes = np.zeros(len(parts), np.int32)
        plain = np.fromiter((x.isascii() and x.isprintable() and "'" not in x and "<|" not in x for x in parts), bool, len(parts))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        flats = [np.zeros(0, "<u4")]
        for model, own in ((self.bare, order[: plain.sum()]), (self.model, order[plain.sum() :])):
            for i in range(0, len(own), ENCODE_WORDS):
                block = own[i : i + ENCODE_WORDS]
                found = model.encode([parts[k].lower() if model is self.bare else parts[k] for k in block], is_pretokenized=True, add_special_tokens=False)
                flats.append(np.array(found.ids, dtype="<u4"))
                sizes[block] = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(block))
        flat = np.concatenate(flats)
        starts = np.empty(len(parts), np.int32)
        starts[order] = np.cumsum(sizes[order], dtype=np.int32) - sizes[order]
        return gather(flat, starts, sizes, np.arange(len(parts))), sizes

    def _learn(self, fresh: pa.Array) -> None:
        parts, of = [], []
        for k, unit in enumerate(fresh.to_pylist()):
            if unit.isascii() and "'" not in unit and "<|" not in unit:
                parts.append(unit)
                of.append(k)
            else:
                own = word_parts(unit)
                parts += own
                of += [k] * len(own)
        flat, sizes = self._encode(parts)
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat = np.concatenate([self.flat, flat])
        self.sizes = np.concatenate([self.sizes, np.bincount(of, weights=sizes, minlength=len(fresh)).astype(np.int32)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids of each text)."""
        units, per_text = units_of(texts)
        coded = units.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        if place.null_count:
            if self.known.nbytes + self.flat.nbytes + self.sizes.nbytes > CACHE_BYTES:
                self.clear()
                place = pc.index_in(coded.dictionary, value_set=self.known)
            fresh = pc.is_null(place)
            first = len(self.known)
            self._learn(coded.dictionary.filter(fresh))
            place, new = pc.fill_null(place, 0).to_numpy().copy(), np.flatnonzero(fresh.to_numpy(zero_copy_only=False))
            place[new] = np.arange(first, first + len(new))
        else:
            place = place.to_numpy()
        codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(units) else np.zeros(0, np.int32)
        starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        stream = gather(self.flat, starts, self.sizes, codes)
        ends = np.concatenate([[0], np.cumsum(self.sizes[codes], dtype=np.int64)])
        return stream, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def _pieces_of(path: str, capacity: int, end_id: int, keep_ids: bool):
    def encode(model, ids_of, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if ids_of is None:  # any other tokenizer: whole texts
            ids = [e.ids for e in model.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for own in ids for x in own], dtype="<u4"), np.array([len(own) for own in ids], dtype=np.int64)
        if len(texts) == 1 and len(texts[0].as_buffer()) > 2 * SLICE_TEXT:
            streams = [ids_of.ids(pa.array([run], pa.large_string()))[0] for run in runs_of(texts[0].as_py(), SLICE_TEXT)]
            return np.concatenate(streams), np.array([sum(map(len, streams))], dtype=np.int64)
        return ids_of.ids(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = worker_kept(("tokenizer", path), lambda: Tokenizer.from_file(path))
        ids_of = worker_kept(("unit ids", path), lambda: WordIds(model) if WordIds.fits(model) else None)
        give_back()  # what reading the model's file took
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length that this task has made
        for doc_ids, texts in text_slices(joined(batches, SLICE_TEXT), limit=SLICE_TEXT):
            bare, of_row = encode(model, ids_of, texts)
            held = of_row + 1
            ends = np.cumsum(held)
            stream = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(stream), bool)
            inside[ends - 1] = False
            stream[inside] = bare
            pieces = -(-held // capacity)
            row = np.repeat(np.arange(len(held)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, held[row] - start)
            at = (ends - held)[row] + start
            raw = memoryview(stream.view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
            # rank among the task's pieces of equal length
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            n_of = np.diff(np.append(first, len(by)))
            own = np.empty(len(by), np.int64)
            own[order] = np.arange(len(by)) - np.repeat(first, n_of) + seen[by]
            seen[by[first]] += n_of
            cols = [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(own)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "own"]
            if keep_ids:
                values = pa.array(stream.view(np.int32))
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(stream)), pa.int32()), values))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return tidy(run)


def _placed(plan: list):
    """Where the n-th piece of a length goes: sequence_id and offset, from arrays bounded by the plan."""
    key, first, times, at, seq = [], [], [], [], []
    used: dict[int, int] = {}
    bins = 0
    for pattern, repeat in plan:
        offset = 0
        for length, n in pattern:
            key.append((length, used.get(length, 0)))
            first.append(used.get(length, 0))
            times.append(n)
            at.append(offset)
            seq.append(bins)
            used[length] = used.get(length, 0) + n * repeat
            offset += n * length
        bins += repeat
    order = sorted(range(len(key)), key=lambda i: key[i])
    cols = [np.array([x[i] for i in order], dtype=np.int64) for x in ([k[0] for k in key], first, times, at, seq)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, times, at, seq = cols
        width = np.int64(1) << 45
        keys = lengths * width + first
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(keys, length * width + rank, side="right") - 1
            slot = rank - first[i]
            made = [pa.array(seq[i] + slot // times[i], pa.int64()), pa.array(at[i] + slot % times[i] * length, pa.int64())]
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *made], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    made = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = made.mapInArrow(_pieces_of(tokenizer_path, capacity, end_id, keep_ids), schema + ", own long" + (", ids array<int>" if keep_ids else ""))
    rows = store(made.withColumn("part", F.spark_partition_id()), "pieces").df
    # a piece's rank within its length: its rank in its task, after the pieces of all tasks before; rows do not move
    cells = store(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts").df
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _, _ = complete_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    before = F.broadcast(before) if cells.count() <= BROADCAST_ROWS else before.hint("shuffle_hash")
    ranked = rows.join(before, ["length", "part"]).withColumn("rank", (F.col("before") + F.col("own")).cast("long"))
    ids = ["ids"] if keep_ids else []
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "rank")
    return ranked.mapInArrow(_placed(plan), schema + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")


def op8_pack_documents(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path)
