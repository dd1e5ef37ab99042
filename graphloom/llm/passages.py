"""Operator 3: near-duplicate passages across documents, by compact windows.

The tokens of a text are its runs of five words. For each of a few hash functions, a *compact window* is a
token with the widest stretch around it in which no token hashes lower: all passages within the stretch that
contain the token have it as their min-hash. The windows of a text are the nodes of the Cartesian tree over
its token hashes; only nodes as wide as the shortest passage matter, and these are found by sliding minima
and joined to the tree by one pass over themselves.

Windows of one (hash function, token) are sorted by document and position. Up to ``FEW`` + 1 of them are all linked with
each other. A token with more is *hot*: it may stand in a common passage as well as, with a common line, in foreign
contexts. What hot windows can share is found exactly, by the tokens themselves (``_shared``): a passage that is near
another consists, but for its edits, of tokens that stand elsewhere too. In stretches that do

- a token that up to ``FEW`` + 1 places of hot windows have links all of them with each other;
- of the other, frequent tokens each place knows its first one: a stretch with most of its tokens from one earlier document
  is linked to it, and a stretch whose frequent tokens are all those of another is linked to the first such stretch;
- the first stretches of each kind that are of no earlier document are searched again among themselves, where most frequent
  tokens are not frequent any more. When a round does not make them fewer, all that share
  a run of ``RUN`` tokens are linked: two edits leave as long a run in the shortest passage.

So a group of n copies gives a multiple of n links, never all pairs, and no place is left out for being frequent. Each task
first links its own rows and sends one place of a token that it knows to be hot.
The links of two documents are joined as intervals: where enough hash functions agree along one diagonal, there
is a candidate passage, which is then verified token by token: its tokens must be at least ``percent`` similar
(Jaccard) to those of the other passage.

Empty cases: null, empty and short texts have no passage. Rows without ``doc_id`` take no part. Rows of one ``doc_id``
count as one document, whose passages are told by ``text_key``, a hash of the text that holds them, where its rows differ
in their text; passages repeated within a document are not reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import Words, free_name, groups, mix, parts, shingles, signed, steps
from graphloom.session import scratch_path, scratch_scope, settings

TOKEN_WORDS = 5
HASHES = 5
AGREE = 2
#: Windows of one (hash function, token) that are all linked with each other.
FEW = 8
#: Stands in links for the hash function where a stretch is found by its tokens.
EXACT = 7
#: Per cent of a stretch of the shortest length by which less of it may be shared than of the whole passage.
SLACK = 5
#: Tokens of a run that two stretches of the shortest length share, cut by no more than two edits; and those of its parts that are met.
RUN, PART = 12, 6
#: Bits of a place that hold the position; those above tell the texts of one ``doc_id`` apart.
POSITION = 40
#: Positions between two texts that are searched in one line.
APART = 1 << 20
#: More places than a token can have.
BOUND = 1 << 62
#: The bits of a token that are compared; where two tokens have the same, the texts are compared in the end.
TOKEN = (1 << 40) - 2
#: Boxes of packed rows for each task that reads them.
BOXES = 8
#: Rows that a task holds before it looks for those that belong together, and rows that it packs at once.
HELD, AT_ONCE = 1_000_000, 100_000
#: Where rows are texts or packed, so many of them fill a batch for Python.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
#: Bytes of first stretches that one task searches again.
TASK_BYTES = 1 << 20
#: Tokens that two places of one passage may be shifted against each other within one diagonal.
DRIFT = 24
#: Stretches that are read from a text at once.
ASKED = 64
#: Foreign tokens in a row that a verified passage may hold; three edited words with their neighbours fit the first.
GAPS = (16, 8, 5, 1)

_CANDIDATE = ["doc_b", "s_b", "e_b", "doc_a", "s_a", "e_a"]
_LINKS = "doc_b long, doc_a long, k int, shift int, s int, e int"


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _lower_before(value: np.ndarray, whose: np.ndarray) -> np.ndarray:
    """For each value the last lower one before it of the same text, or -1."""
    at = np.arange(len(value)) - 1
    todo = np.arange(1, len(value))
    while len(todo):
        # what a higher value has found so far lies before all that it is lower than
        higher = value[at[todo]] > value[todo]
        higher &= whose[at[todo]] == whose[todo]
        todo = todo[higher]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    at[(at >= 0) & (whose[at] != whose)] = -1
    return at


def compact_windows(tokens: np.ndarray, at: np.ndarray, seed: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, left and right ends (inclusive) of all windows of at least ``width`` tokens; no window leaves its text."""
    empty = np.zeros(0, np.int64)
    n = len(tokens)
    if n < width:
        return empty, empty, empty
    place = np.uint64(max(int(n - 1).bit_length(), 1))
    v = mix(tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    v = (v >> place << place) | np.arange(n, dtype=np.uint64)  # ties go to the left
    low = _slide_min(v, width)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    low = low[text[: n - width + 1] == text[width - 1 :]]
    if not len(low):
        return empty, empty, empty
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    # the place of the lowest never goes back
    centre = (low[new] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    # a token lower than one of these and next to its stretch has a wide stretch itself, so the tree over these suffices
    value, whose = v[centre], text[centre]
    before = _lower_before(value, whose)
    after = len(centre) - 1 - _lower_before(value[::-1], whose[::-1])[::-1]
    left = np.where(before >= 0, centre[before] + 1, at[:-1][whose])
    right = np.where(after < len(centre), centre[np.minimum(after, len(centre) - 1)] - 1, at[1:][whose] - 1)
    wide = right - left + 1 >= width
    return centre[wide], left[wide], right[wide]


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(column)
    tokens, at = shingles(words.hashes(), words.offsets, TOKEN_WORDS)
    return words, tokens, at


def _links(key, doc, c, left, right, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Links of rows sorted by key, document and position to the row at ``first``: shift and common stretch."""
    return_to = []
    for other in first:
        ok = (other >= 0) & (doc[other] != doc)
        i, j = np.flatnonzero(ok), other[ok]
        before = np.minimum(c[i] - left[i], c[j] - left[j])
        after = np.minimum(right[i] - c[i], right[j] - c[j])
        wide = before + after + 1 >= width
        i, j, before, after = i[wide], j[wide], before[wide], after[wide]
        return_to.append(np.stack([doc[i], doc[j], key[i] & 7, c[j] - c[i], c[i] - before, c[i] + after], axis=1))
    return return_to


def _link_batch(m: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(m[:, i], k) for i, k in enumerate(kinds)], ["doc_b", "doc_a", "k", "shift", "s", "e"])


def _heads(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and document: the first row of the key, and the last row of the document before (or -1)."""
    n = np.arange(len(key))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new_key, n, 0))
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    before = np.maximum.accumulate(np.where(new_doc, n, 0)) - 1
    return head, np.where(before >= head, before, -1)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Different rows, sorted by their columns from the first."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


_TAGGED = "kind byte, x long, y long, c int, l int, r int, z int"


def _tagged(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``_TAGGED``: ``kind = 0`` windows, ``kind = 1`` links, ``kind = 2`` hot windows; missing columns are 0."""
    n = len(columns[0])
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    arrays = [np.full(n, kind), *columns, *[np.zeros(n, np.int64)] * (6 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds)], ["kind", "x", "y", "c", "l", "r", "z"])


def _tagged_links(links: list[np.ndarray]) -> pa.RecordBatch:
    return _tagged(1, list(_distinct(np.concatenate(links)).T))


def _covered(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The stretches ``doc, left, right`` that stretches cover: joined where they meet."""
    order = np.lexsort((left, doc))
    doc, left, right = doc[order], left[order], right[order]
    group = np.concatenate([[0], np.cumsum(np.diff(doc) != 0)])[: len(doc)]
    span = int(right.max(initial=0)) + 2
    far = np.maximum.accumulate(group * span + right)
    new = np.ones(len(doc), bool)
    new[1:] = group[1:] * span + left[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return np.column_stack([doc[first], left[first], far[last] - group[last] * span])


def _hot(stretches: np.ndarray) -> pa.RecordBatch:
    doc, left, right = _covered(*stretches.T).T
    return _tagged(2, [np.zeros(len(doc), np.int64), doc, np.zeros(len(doc), np.int64), left, right])


def _window_rows(docs: DataFrame, width: int) -> DataFrame:
    """Windows, of each token the first ``FEW + 1`` of the task; of the others the links found in the task, and all hot windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # windows of different hash functions never meet
        held: list[list[np.ndarray]] = [[] for _ in range(HASHES)]

        def flush() -> Iterator[pa.RecordBatch]:
            hot = []
            for rows in held:
                m = np.concatenate(rows)
                rows.clear()
                m = m[np.lexsort((m[:, 2], m[:, 1], m[:, 0]))]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]).any(axis=1)
                m = m[new]
                key, doc, c, left, right = m.T
                head, before = _heads(key, doc)
                rank = np.arange(len(key)) - head
                stay = rank <= FEW
                yield _tagged(0, list(m[stay].T))
                yield _tagged_links(_links(key, doc, c, left, right, [np.where(stay, -1, head), np.where(stay, -1, before)], width))
                several = np.isin(head, head[~stay])
                hot.append(_covered(doc[several], left[several], right[several]))
            yield _hot(np.concatenate(hot))

        for step in steps(batches):
            _, tokens, at = _tokens(step.column("text"))
            if not len(tokens):
                continue
            doc = step.column("doc_id").to_numpy()
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for k in range(HASHES):
                c, left, right = compact_windows(tokens, at, k + 1, width)
                key = (mix(tokens[c] ^ np.uint64(k)) >> np.uint64(3) << np.uint64(3)) | np.uint64(k)
                base = at[text[c]]
                held[k].append(np.stack([signed(key), doc[text[c]], c - base, left - base, right - base], axis=1))
            if sum(len(m) for rows in held for m in rows) > HELD:
                yield from flush()
        if held[0]:
            yield from flush()

    return docs.mapInArrow(cut, _TAGGED)


#: Packed rows: numbers of each row, by kind. Places by token, places by document (with the first place of a frequent
#: token), places by rare token, starts of stretches by their frequent tokens, links, and first stretches by document.
_PACKED = "kind byte, box int, rows binary"
_BY_TOKEN, _BY_DOC, _RARE, _ALIKE, _LINK, _FIRST = range(6)
_NUMBERS = (3, 5, 3, 3, 6, 2)


def _bytes(m: np.ndarray) -> bytes:
    """Differences of each column, first bytes first, so that what hardly differs takes next to no disk."""
    step = np.ascontiguousarray(np.diff(m, axis=0, prepend=np.zeros((1, m.shape[1]), np.int64)).T)
    return step.view(np.uint8).reshape(m.shape[1], len(m), 8).transpose(0, 2, 1).tobytes()


def _of_bytes(data: bytes, numbers: int) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(numbers, 8, -1).transpose(0, 2, 1)).view(np.int64)
    return np.cumsum(step.reshape(numbers, -1), axis=1).T


def _packed(kind: int, by: np.ndarray, rows: np.ndarray | Callable[[np.ndarray], np.ndarray], boxes: int) -> Iterator[pa.RecordBatch]:
    """Rows dealt to boxes by a number of each, some boxes at once; ``rows`` may be worked out for these alone."""
    if not len(by):
        return
    box = np.empty(len(by), np.int32)
    for x in range(0, len(by), AT_ONCE):
        box[x : x + AT_ONCE] = mix(by[x : x + AT_ONCE].astype(np.int64).view(np.uint64)) % np.uint64(boxes)
    order = np.argsort(box, kind="stable")
    box = box[order]
    first = np.flatnonzero(np.diff(box, prepend=-1))
    new = np.append(np.flatnonzero(np.diff(first // AT_ONCE, prepend=-1)), len(first))
    for x, y in zip(new[:-1].tolist(), new[1:].tolist()):
        begin, end = first[x], first[y] if y < len(first) else len(order)
        m = rows(order[begin:end]) if callable(rows) else rows[order[begin:end]]
        found = [_bytes(part) for part in np.split(m, first[x + 1 : y] - begin)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, kind), pa.int8()), pa.array(box[first[x:y]]), pa.array(found, pa.binary())], ["kind", "box", "rows"])


def _numbers(kind: int, column) -> np.ndarray:
    rows = [_of_bytes(x, _NUMBERS[kind]) for x in column.to_pylist()]
    return np.concatenate(rows) if rows else np.zeros((0, _NUMBERS[kind]), np.int64)


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
    """The rows of each box by their kind, from batches sorted by box and kind."""
    box, held = None, {}
    for group in groups(batches, ["box", "kind"]):
        kind = group.column("kind")[0].as_py()
        if held and group.column("box")[0].as_py() != box:
            yield held
            held = {}
        box = group.column("box")[0].as_py()
        held[kind] = _numbers(kind, group.column("rows"))
    if held:
        yield held


def _runs(m: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Links from rows ``doc, of, shift, at`` of stretches that begin at ``at``; runs along a diagonal as one.

    Where a stretch is not shared as a whole, its links reach as far beyond it as a shift within the passage can.
    """
    m = _distinct(np.column_stack([m[:, :3], ~whole, m[:, 3]]))
    apart = np.ones(len(m), bool)
    apart[1:] = (m[1:, :4] != m[:-1, :4]).any(axis=1) | (m[1:, 4] != m[:-1, 4] + 1)
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(m))[: len(first)] - 1
    more = m[first, 3] * DRIFT
    return np.column_stack([m[first, :2], np.full(len(first), EXACT), m[first, 2], m[first, 4] - more, m[last, 4] + width - 1 + more])


def _spots(m: np.ndarray, width: int) -> np.ndarray:
    """Of sorted places ``token, doc, place`` those that begin a spot: a token again and again within ``width`` is at one spot."""
    new = np.ones(len(m), bool)
    new[1:] = (m[1:, :2] != m[:-1, :2]).any(axis=1) | (np.diff(m[:, 2]) > width)
    return new


def _frequent(m: np.ndarray, width: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted places ``token, doc, place``: the first row of the token, whether it has more than ``few`` spots, and several documents.

    The lowest bit of a token is set where the place stands for those of a hot token in a task.
    """
    token = m[:, 0] >> 1
    head, before = _heads(token, m[:, 1])
    if not len(m):
        return head, np.zeros(0, bool), np.zeros(0, bool)
    first = np.flatnonzero(head == np.arange(len(m)))
    n = np.diff(np.append(first, len(m)))
    known = np.add.reduceat(m[:, 0] & 1, first) > 0
    several = known | np.logical_or.reduceat(before >= 0, first)
    spots = np.add.reduceat(_spots(np.column_stack([token, m[:, 1:]]), width).astype(np.int64), first)
    return head, np.repeat(known | several & (spots > few), n), np.repeat(several, n)


def _led(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of hot tokens for their documents, each with the first place of the token."""
    return np.column_stack([m[:, 1], m[:, 2], m[:, 0] | 1, first[:, 1], first[:, 2] & ((1 << POSITION) - 1)])


def _places(held: list[np.ndarray], width: int, boxes: int, few: int) -> Iterator[pa.RecordBatch]:
    """Places ``token, doc, place`` of a task by their tokens; those of hot tokens by their documents, and one place for all of them.

    What is held is taken; tokens are looked at a part of them at a time.
    """
    m = np.concatenate(held)
    held.clear()
    first, hot, part = np.empty(len(m), np.int64), np.empty(len(m), bool), (m[:, 0] >> 1 & 7).astype(np.int8)
    for i in range(8):
        own = np.flatnonzero(part == i)
        order = own[np.lexsort((m[own, 2], m[own, 1], m[own, 0]))]
        head, frequent, _ = _frequent(m[order], width, few)
        first[order], hot[order] = order[head], frequent
    which = np.flatnonzero(hot)
    yield from _packed(_BY_DOC, m[which, 1], lambda some: _led(m[which[some]], m[first[which[some]]]), boxes)
    one = m[hot & (first == np.arange(len(m)))]
    one[:, 0] |= 1
    rows = np.concatenate([one, m[~hot]])
    yield from _packed(_BY_TOKEN, rows[:, 0] >> 1, rows, boxes)


def _texts(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sorted places, and the same with texts far apart."""
    at = place & ((1 << POSITION) - 1)
    new = (np.diff(doc) != 0) | (np.diff(place >> POSITION) != 0)
    return at, np.concatenate([[0], np.cumsum(new)])[: len(at)] * (int(at.max(initial=0)) + APART) + at


def _dense(line: np.ndarray, width: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of ``width`` that begin at each of sorted positions: how many lie within, and whether they can begin a passage."""
    n = len(line)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    within = np.searchsorted(line, line + width) - np.arange(n)
    end = np.append(np.flatnonzero(np.diff(line) > GAPS[0] + 1), n - 1)
    reach = line[end[np.searchsorted(end, np.arange(n))]]
    return within, (within >= need) & (reach - line + 1 >= width)


def _parts_of_runs(tokens: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens by position: where the parts begin that two equal runs of ``RUN`` have in common, and their hashes (the lowest near each)."""
    n = len(tokens) - PART + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part, _ = shingles(tokens.view(np.uint64), np.array([0, len(tokens)]), PART)
    part = np.where(line[PART - 1 :] - line[:n] == PART - 1, part | np.uint64(1), np.uint64(np.iinfo(np.uint64).max))
    near = RUN - PART + 1
    low = _slide_min(np.concatenate([np.full(near - 1, np.iinfo(np.uint64).max, np.uint64), part, np.full(near - 1, np.iinfo(np.uint64).max, np.uint64)]), near)
    # a part is the lowest of some ``near`` in a row where it is no higher than the highest of their minima
    least = ~_slide_min(~low, near)
    begin = np.flatnonzero((part == least) & (part != np.iinfo(np.uint64).max))
    return begin, signed(part[begin])


def _near(m: np.ndarray, width: int, percent: int, least_hot: int, runs: bool) -> tuple[np.ndarray, ...]:
    """Of places ``doc, place, token, first doc, first position`` of whole texts: rare tokens, links and stretches to be met elsewhere.

    With ``runs`` no token is frequent, and what meets are parts of runs. Rare tokens are of stretches with ``least_hot`` frequent tokens at least; all others are found by their windows.
    """
    need = width * (percent - SLACK) // 100
    m = m[np.lexsort((m[:, 3], m[:, 1], m[:, 0]))]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:, :2] != m[:-1, :2]).any(axis=1)
    m = m[new]
    hot = (m[:, 2] & 1) == 1
    at, line = _texts(m[:, 0], m[:, 1])
    within, dense = _dense(line, width, need)
    total = np.concatenate([[0], np.cumsum(hot)])
    begin = np.flatnonzero(dense)
    end = begin + within[begin]
    mixed = total[end] - total[begin] >= least_hot
    cover = np.zeros(len(m) + 1, np.int64)
    np.add.at(cover, begin[mixed], 1)
    np.add.at(cover, end[mixed], -1)
    rare = (np.cumsum(cover)[:-1] > 0) & ~hot
    if runs:
        m = m[rare]
        begin, part = _parts_of_runs(m[:, 2], line[rare])
        return (np.column_stack([part, m[begin, :2]]),)
    found_rare, m, at, line = np.column_stack([m[rare, 2], m[rare, 0], m[rare, 1]]), m[hot], at[hot], line[hot]
    within, dense = _dense(line, width, need)
    # stretches with most of their tokens from one earlier document
    led = np.zeros(len(m), np.int64)
    text = np.concatenate([[0], np.cumsum(np.diff(line) - np.diff(at))])[: len(m)]
    other = np.flatnonzero(m[:, 3] != m[:, 0])
    order = other[np.lexsort((at[other], m[other, 3], text[other]))]
    of = np.concatenate([[0], np.cumsum((np.diff(m[order, 3]) != 0) | (np.diff(text[order]) != 0))])[: len(order)]
    led[order], enough = _dense(of * (int(at.max(initial=0)) + APART) + at[order], width, need)
    order = order[enough]
    found = _runs(np.column_stack([m[order, 0], m[order, 3], m[order, 4] - at[order], at[order]]), width, led[order] == width)
    # stretches by the sum of their frequent tokens; those that have a document to be near to are found
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(m[:, 2].view(np.uint64)))])
    begin = np.flatnonzero(dense & (led < -(-2 * percent * width // (100 + percent))))
    alike = sums[begin + within[begin]] - sums[begin]
    alike = signed((alike & ~np.uint64(1)) | (within[begin] == width).astype(np.uint64))
    return found_rare, found, np.column_stack([alike, m[begin, 0], m[begin, 1]])


def _alike(m: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of stretches ``sum, doc, place`` to the first of their sum, and these first ones."""
    m = m[np.lexsort((m[:, 2], m[:, 1], m[:, 0]))]
    head, _ = _heads(m[:, 0], m[:, 1])
    at = m[:, 2] & ((1 << POSITION) - 1)
    i = np.flatnonzero(m[head, 1] != m[:, 1])
    found = _runs(np.column_stack([m[i, 1], m[head[i], 1], at[head[i]] - at[i], at[i]]), width, (m[i, 0] & 1) == 1)
    return found, m[head == np.arange(len(m))]


def _met(m: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Links between all spots of each token, from places ``token, doc, place``: their beginnings and their ends."""
    m = _distinct(m)
    first = np.flatnonzero(_spots(m, width))
    last = np.append(first[1:], len(m))[: len(first)] - 1
    head, _ = _heads(m[first, 0], m[first, 1])
    rank, more = np.arange(len(first)) - head, width - 1 + DRIFT
    for lag in range(1, int(rank.max(initial=0)) + 1):
        i = np.flatnonzero(rank >= lag)
        i = i[m[first[i], 1] != m[first[i - lag], 1]]
        ends = np.flatnonzero((first[i] < last[i]) | (first[i - lag] < last[i - lag]))
        a, b = np.concatenate([first[i - lag], last[i - lag][ends]]), np.concatenate([first[i], last[i][ends]])
        at, to = (m[x, 2] & ((1 << POSITION) - 1) for x in (b, a))
        yield np.column_stack([m[b, 1], m[a, 1], np.full(len(a), EXACT), to - at, at - more, at + more])


def _by_doc(kind: int, held: list[np.ndarray], boxes: int) -> Iterator[pa.RecordBatch]:
    """Rows that begin with their document and what comes second there, sorted by both; what is held is taken."""
    if not held:
        return
    m = np.concatenate(held)
    held.clear()
    order = np.lexsort((m[:, 1], m[:, 0]))
    yield from _packed(kind, m[order, 0], lambda some: m[order[some]], boxes)


def _shared(docs: DataFrame, hot: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between stretches of hot windows, by the tokens that they share."""
    spark = docs.sparkSession
    n = parts(spark)
    boxes = BOXES * n

    def written(rows: DataFrame) -> DataFrame:
        """One file a task: for each folder and file the local file system starts a process, which counts as large as its executor for a moment."""
        path = scratch_path(spark, "shared")
        with settings(spark, FEW_ROWS):
            rows.write.parquet(path)
        return spark.read.schema(_PACKED).parquet(path)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("kind", "box", "rows").repartition(tasks, "box").sortWithinPartitions("box", "kind")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for step in steps(batches):
            _, tokens, at = _tokens(step.column("text"))
            spans = step.column("spans")
            row = np.repeat(np.arange(step.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            left, right = (spans.flatten().field(c).to_numpy().astype(np.int64) for c in ("l", "r"))
            asked = np.zeros(len(tokens) + 1, np.int64)
            # a repeated row of a doc_id may be shorter
            np.add.at(asked, np.minimum(at[row] + left, at[row + 1]), 1)
            np.add.at(asked, np.minimum(at[row] + right + 1, at[row + 1]), -1)
            where = np.flatnonzero(np.cumsum(asked)[:-1] > 0)
            text = np.repeat(np.arange(step.num_rows), np.diff(at))[where]
            place = (step.column("text_key").to_numpy()[text] & 0x3FFFFF) << POSITION | (where - at[text])
            held.append(np.column_stack([signed(tokens[where]) & TOKEN, step.column("doc_id").to_numpy()[text], place]))
            if sum(map(len, held)) > HELD:
                yield from _places(held, width, boxes, FEW + 1)
        if held:
            yield from _places(held, width, boxes, FEW + 1)

    spans = hot.groupBy("doc_id").agg(F.collect_set(F.struct("l", "r")).alias("spans"))
    texts = docs.join(spans, "doc_id").withColumn("text_key", text_key(F.col("text")))
    places = written(texts.mapInArrow(cut, _PACKED))
    links, before, few, least_hot, tasks = [], None, FEW + 1, 1, n
    while True:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for box in _boxes(batches):
                m = box[_BY_TOKEN]
                m = m[np.lexsort((m[:, 2], m[:, 1], m[:, 0] >> 1))]
                head, hot, several = _frequent(m, width, few)
                held.append(_led(m[hot], m[head[hot]]))
                m = m[several & ~hot]
                held.append(np.column_stack([m[:, 1], m[:, 2], m[:, 0], *np.zeros((2, len(m)), np.int64)]))
                if sum(map(len, held)) > HELD // 2:
                    yield from _by_doc(_BY_DOC, held, boxes)
            yield from _by_doc(_BY_DOC, held, boxes)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            n = 0

            def flush() -> Iterator[pa.RecordBatch]:
                rare, *more = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield from _packed(_RARE, rare[:, 0], rare, boxes)
                if more:
                    found, alike = _alike(more[1], width)
                    yield from _by_doc(_LINK, [more[0], found], boxes)
                    yield from _packed(_ALIKE, alike[:, 0], alike, boxes)

            for box in _boxes(batches):
                n += len(box[_BY_DOC])
                held.append(_near(box[_BY_DOC], width, percent, least_hot, few > BOUND))
                if n > HELD:
                    yield from flush()
                    n = 0
            if held:
                yield from flush()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            links: list[np.ndarray] = []
            firsts: list[np.ndarray] = []
            for box in _boxes(batches):
                if _RARE in box:
                    n = 0
                    for found in _met(box[_RARE], width):
                        links.append(found)
                        n += len(found)
                        if n > HELD // 4:
                            yield from _by_doc(_LINK, links, boxes)
                            n = 0
                if _ALIKE in box:
                    found, first = _alike(box[_ALIKE], width)
                    links.append(found)
                    firsts.append(first[:, 1:])
                if sum(map(len, links)) > HELD // 4:
                    yield from _by_doc(_LINK, links, boxes)
                if sum(map(len, firsts)) > HELD // 2:
                    yield from _by_doc(_FIRST, firsts, boxes)
            yield from _by_doc(_LINK, links, boxes)
            yield from _by_doc(_FIRST, firsts, boxes)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The frequent tokens of the first stretches."""
            held: list[np.ndarray] = []
            for box in _boxes(batches):
                if _FIRST not in box:
                    continue
                own, first = box[_BY_DOC], box[_FIRST]
                own = own[(own[:, 2] & 1) == 1]
                both = np.concatenate([own[:, :2], first])
                order = np.lexsort((both[:, 1], both[:, 0]))
                line = np.empty(len(both), np.int64)
                line[order] = _texts(*both[order].T)[1]
                by, begin = np.argsort(line[: len(own)], kind="stable"), np.sort(line[len(own) :])
                place = line[: len(own)][by]
                # the last stretch that begins at a place or before reaches it
                last = np.searchsorted(begin, place, "right") - 1
                found = own[by][(last >= 0) & (place - begin[last] < width)]
                held.append(_distinct(np.column_stack([found[:, 2] & ~1, found[:, :2]])))
                if sum(map(len, held)) > HELD:
                    yield from _places(held, width, boxes, few)
            if held:
                yield from _places(held, width, boxes, few)

        counted = written(dealt(places.where(F.col("kind") == _BY_TOKEN)).mapInArrow(count, _PACKED))
        own = places.where(F.col("kind") == _BY_DOC).union(counted.where(F.col("kind") == _BY_DOC))
        found = written(dealt(own).mapInArrow(search, _PACKED))
        met = written(dealt(found.where(F.col("kind").isin(_RARE, _ALIKE))).mapInArrow(meet, _PACKED))
        links += [x.where(F.col("kind") == _LINK) for x in (found, met)]
        first = met.where(F.col("kind") == _FIRST)
        left = first.agg(F.sum(F.length("rows"))).first()[0]
        if not left:
            break
        if before is not None and left > 0.9 * before:
            few = BOUND + 1
        before, least_hot = left, 0
        places = written(dealt(own.union(first)).mapInArrow(again, _PACKED))
        # later rounds are small, but for what the last one meets
        tasks = n if few > BOUND else int(min(n, left // TASK_BYTES + 1))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "rows", 8 * _NUMBERS[_LINK] * AT_ONCE):
            m = _distinct(_numbers(_LINK, step.column("rows")))
            for at in range(0, len(m), AT_ONCE):
                yield _link_batch(m[at : at + AT_ONCE])

    rows = links[0]
    for x in links[1:]:
        rows = rows.union(x)
    return rows.select("rows").mapInArrow(unpacked, _LINKS).select("doc_b", "doc_a", "k", "shift", "s", "e")


def _as_links(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 1").select(
        F.col("x").alias("doc_b"), F.col("y").alias("doc_a"), F.col("c").alias("k"), F.col("l").alias("shift"), F.col("r").alias("s"), F.col("z").alias("e")
    )


def candidates(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """Pairs of passages on which enough hash functions agree: ``doc_b, s_b, e_b, doc_a, s_a, e_a`` in tokens, doc_a before doc_b."""
    spark = docs.sparkSession

    def link(batches):
        """Rows sorted by key, document and position: links to all rows before; beyond ``FEW`` to the first and the preceding document, and the hot windows."""
        tail = np.zeros((0, 5), np.int64)  # of the last key the first rows and the last one
        seen = 0  # rows of the last key
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("key", "doc_id", "c", "l", "r")], axis=1)
            if not seen or tail[0][0] != m[0][0]:
                tail, seen = tail[:0], 0
            old = len(tail)
            m = np.concatenate([tail, m])
            key, doc, c, left, right = m.T
            head, before = _heads(key, doc)
            n = np.arange(len(key))
            rank = n - head
            rank[(head == 0) & (n >= old)] += seen - old
            fresh = n >= old
            few = fresh & (rank <= FEW)
            others = [np.where(few & (n - head >= lag), n - lag, -1) for lag in range(1, FEW + 1)]
            others += [np.where(fresh & ~few, head, -1), np.where(fresh & ~few, before, -1)]
            yield _tagged_links(_links(key, doc, c, left, right, others, width))
            # a hot key gives its first rows too, as soon as it is known to be hot
            hot = np.isin(head, head[fresh & (rank > FEW)])
            yield _hot(m[hot][:, [1, 3, 4]])
            last = head[-1]
            seen = int(rank[-1]) + 1
            tail = m[last:] if seen <= FEW + 1 else np.concatenate([m[last : last + FEW + 1], m[max(len(m) - 1, last + FEW + 1) :]])

    n = parts(spark)
    path = scratch_path(spark, "links")
    with scratch_scope(spark):  # windows are not needed any more
        inner = scratch_path(spark, "windows")
        with settings(spark, FEW_ROWS):
            _window_rows(docs, width).write.partitionBy("kind").parquet(inner)
        rows = spark.read.schema(_TAGGED).parquet(inner)
        windows = rows.where("kind = 0").select(F.col("x").alias("key"), F.col("y").alias("doc_id"), "c", "l", "r")
        met = windows.repartition(n, "key").sortWithinPartitions("key", "doc_id", "c").mapInArrow(link, _TAGGED)
        met.unionByName(rows.where("kind > 0")).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(_TAGGED).parquet(path)
    hot = rows.where("kind = 2").select(F.col("y").alias("doc_id"), "l", "r")

    def join(batches):
        """Intervals of pairs of documents, whole pairs at a time: stretches along a diagonal on which enough hash functions agree."""
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("doc_b", "doc_a", "k", "shift", "s", "e")], axis=1)
            change = np.flatnonzero((m[1:, :2] != m[:-1, :2]).any(axis=1))
            end = int(change[-1]) + 1 if len(change) else 0
            if not end and held and (held[-1][-1, :2] == m[0, :2]).all():
                held.append(m)
                continue
            whole = np.concatenate([*held, m[:end]])
            held = [m[end:]]
            if len(whole):
                yield _stretches(whole)
        if held:
            yield _stretches(np.concatenate(held))

    def _stretches(m):
        kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_agreed(m, width).T, kinds)], _CANDIDATE)

    links = _as_links(rows).union(_shared(docs, hot, width, percent))
    ordered = links.select(
        F.greatest("doc_a", "doc_b").alias("doc_b"), F.least("doc_a", "doc_b").alias("doc_a"), "k",
        F.expr("IF(doc_b > doc_a, shift, -shift)").alias("shift"), F.expr("IF(doc_b > doc_a, s, s + shift)").alias("s"), F.expr("IF(doc_b > doc_a, e, e + shift)").alias("e"),
    )
    ordered = ordered.repartition(n, "doc_b", "doc_a").sortWithinPartitions("doc_b", "doc_a")
    return ordered.mapInArrow(join, "doc_b long, s_b int, e_b int, doc_a long, s_a int, e_a int")


def _agreed(m: np.ndarray, width: int) -> np.ndarray:
    """Candidates from links ``doc_b, doc_a, k, shift, s, e`` of whole pairs of documents.

    Along each diagonal (shifts that follow each other within ``DRIFT``) the maximal stretches, at least ``width`` long, that
    intervals of at least ``AGREE`` hash functions cover, or equal ones.
    """
    m = m[np.lexsort((m[:, 3], m[:, 1], m[:, 0]))]
    apart = (m[1:, :2] != m[:-1, :2]).any(axis=1) | (np.diff(m[:, 3]) > DRIFT)
    part = np.concatenate([[0], np.cumsum(apart)])
    begins = np.flatnonzero(np.concatenate([[True], apart, [True]]))
    k, shift, s, e = m[:, 2:].T
    # the intervals of one hash function as their union: the furthest end so far, group by group
    order = np.lexsort((s, k, part))
    group = np.concatenate([[0], np.cumsum((np.diff(part[order]) != 0) | (np.diff(k[order]) != 0))])
    span = int(e.max()) - int(min(s.min(), 0)) + 2
    far = np.maximum.accumulate(group * span + e[order])
    new = np.ones(len(m), bool)
    new[1:] = group[1:] * span + s[order][1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    rows = order[first]
    weight = np.where(k[rows] == EXACT, AGREE, 1)
    # how many cover each place: steps up and down, whose sum is zero at the end of each diagonal
    where = np.concatenate([s[rows], far[last] - group[last] * span + 1])
    whose, step = np.tile(part[rows], 2), np.concatenate([weight, -weight])
    order = np.lexsort((where, whose))
    where, whose, step = where[order], whose[order], step[order]
    once = np.flatnonzero(np.concatenate([[True], (np.diff(whose) != 0) | (np.diff(where) != 0)]))
    enough = np.cumsum(np.add.reduceat(step, once)) >= AGREE
    edge = np.flatnonzero(np.diff(np.concatenate([[0], enough.astype(np.int8)])))
    x, y, at = where[once][edge[::2]], where[once][edge[1::2]] - 1, whose[once][edge[::2]]
    wide = y - x + 1 >= width
    out = []
    for x, y, i in zip(x[wide].tolist(), y[wide].tolist(), at[wide].tolist()):
        own = slice(begins[i], begins[i + 1])
        near = shift[own][(s[own] <= y) & (e[own] >= x)]  # in their order
        out.append((m[begins[i], 0], x, y, m[begins[i], 1], x + near[0], y + near[-1]))
    return np.array(out, np.int64).reshape(-1, 6)


def _sorted_places(tokens: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens of many stretches by stretch, token and place: the sorted keys, and for each of them its stretch
    and token and its place; and for each place the one before it of the same token and stretch, or -1."""
    n = np.diff(at)
    whose = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    place = (np.arange(len(tokens)) - np.repeat(at[:-1], n)).astype(np.uint64)
    key = np.sort(whose << np.uint64(32 + bits) | tokens.astype(np.uint64) << np.uint64(bits) | place)
    value = key >> np.uint64(bits)
    where = at[(value >> np.uint64(32)).astype(np.int64)] + (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    same = value[1:] == value[:-1]
    before = np.full(len(tokens), -1)
    before[where[1:][same]] = where[:-1][same]
    return key, value, where, before


def _different(before: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Different tokens from each first to each last place."""
    n = np.maximum(last - first + 1, 0)
    end = np.cumsum(n)
    new = before[np.arange(end[-1]) + np.repeat(first - end + n, n)] < np.repeat(first, n)
    total = np.concatenate([[0], np.cumsum(new)])
    return total[end] - total[end - n]


def _verified(b: np.ndarray, b_at: np.ndarray, a: np.ndarray, a_at: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Stretches of ``b`` and ``a`` whose token sets are similar, from the tokens of ``b`` that ``a`` has too.

    Many pairs at once: tokens (32 bits) of pair i are ``b[b_at[i] : b_at[i + 1]]``, and the same of ``a``. Rows ``pair, x, y,
    s, e, both, all``, the last two for the similarity. A stretch whose sets are not similar enough as a whole is cut at ever
    shorter runs of foreign tokens.
    """
    out = [np.zeros((0, 7), np.int64)]
    bits = max(int(max(np.diff(b_at).max(initial=1), np.diff(a_at).max(initial=1)) - 1).bit_length(), 1)
    _, value, place, before_b = _sorted_places(b, b_at, bits)
    key_a, value_a, place_a, before_a = _sorted_places(a, a_at, bits)
    if not len(key_a):
        return out[0]
    # the first place of each token of b in a
    head = np.concatenate([[0], np.flatnonzero(value_a[1:] != value_a[:-1]) + 1])
    found = np.minimum(np.searchsorted(value_a[head], value), len(head) - 1)
    hit = value_a[head][found] == value
    where = np.full(len(b), -1)
    where[place[hit]] = place_a[head[found[hit]]]
    shared = np.flatnonzero((where >= 0) & np.repeat(np.minimum(np.diff(b_at), np.diff(a_at)) >= width, np.diff(b_at)))
    whose = np.searchsorted(b_at, shared, "right") - 1
    group = whose
    for gap in GAPS:
        if not len(shared):
            break
        new = np.concatenate([[True], (np.diff(shared) > gap) | (np.diff(group) != 0)])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(shared)))
        wide = shared[first + n - 1] - shared[first] + 1 >= width
        stay = np.repeat(wide, n)
        shared, whose, n = shared[stay], whose[stay], n[wide]
        if not len(shared):
            break
        first = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        x, y, pair = shared[first], shared[first + n - 1], whose[first]
        to = where[shared]
        shift = (to - a_at[whose]) - (shared - b_at[whose])
        low = int(shift.min())
        span = int(shift.max()) - low + 1
        order = np.sort(run * span + (shift - low)) - run * span + low
        median = np.trunc((order[first + (n - 1) // 2] + order[first + n // 2]) / 2).astype(np.int64)
        fresh = before_b[shared] < x[run]
        one = _different(before_b, x, y)
        sides = [(np.minimum.reduceat(to, first), np.maximum.reduceat(to, first))]
        sides += [(a_at[pair] + np.maximum(x - b_at[pair] + median, 0), a_at[pair] + np.minimum(y - b_at[pair] + median, np.diff(a_at)[pair] - 1))]
        best = np.zeros((len(n), 4), np.int64)
        share = np.zeros(len(n))
        for s, e in sides:
            held = to >= s[run]
            # a token may stand again after its first place
            late = np.flatnonzero(fresh & ~held)
            at = to.copy()
            if len(late):
                asked = (whose[late].astype(np.uint64) << np.uint64(32) | b[shared[late]].astype(np.uint64)) << np.uint64(bits)
                again = np.searchsorted(key_a, asked | (s[run[late]] - a_at[whose[late]]).astype(np.uint64))
                is_one = again < len(key_a)
                again = np.minimum(again, len(key_a) - 1)
                is_one &= value_a[again] == asked >> np.uint64(bits)
                at[late], held[late] = place_a[again], is_one
            both = np.add.reduceat((fresh & held & (at <= e[run])).astype(np.int64), first)
            all_ = one + _different(before_a, s, e) - both
            similar = both / np.maximum(all_, 1)
            better = (similar > share) | (similar == share) & ((s > best[:, 0]) | (s == best[:, 0]) & (e > best[:, 1]))
            better &= (100 * both >= percent * all_) & (both > 0)
            share = np.where(better, similar, share)
            best[better] = np.column_stack([s, e, both, all_])[better]
        good = share > 0
        out.append(np.column_stack([pair, x - b_at[pair], y - b_at[pair], best[:, 0] - a_at[pair], best[:, 1] - a_at[pair], best[:, 2:]])[good])
        left = ~good[run]
        shared, whose, group = shared[left], whose[left], run[left]
    return np.concatenate(out)


def text_key(text):
    """64 bits of a whole text."""
    return F.xxhash64(text)


def repeated_passages(docs: DataFrame, least_words: int = 50, percent: int = 80) -> DataFrame:
    """Each passage of at least ``least_words`` words that is near an earlier document's passage.

    ``doc_id, from_word, to_word`` (the later document; word numbers from 0, both included),
    ``of_doc_id, of_from_word, of_to_word`` (the earlier document), ``similarity`` of the five-word shingles and
    ``text_key``, the hash of the later document's text by :func:`text_key`.
    Every document with the passage but the first is linked to an earlier one.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    width = least_words - TOKEN_WORDS + 1
    path = scratch_path(spark, "candidates")
    with scratch_scope(spark):  # windows, links and stretches are not needed any more
        candidates(docs, width, percent).write.parquet(path)
    found = spark.read.parquet(path)
    sides = found.select(
        F.inline(
            F.array(
                F.struct(F.col("doc_b").alias("doc_id"), F.lit(0).alias("side"), F.col("s_b").alias("s"), F.col("e_b").alias("e")),
                F.struct(F.col("doc_a").alias("doc_id"), F.lit(1).alias("side"), F.col("s_a").alias("s"), F.col("e_a").alias("e")),
            )
        ),
        *_CANDIDATE,
    )

    # each text is cut once for many stretches; where more are asked of one document, several tasks read it
    many = sides.groupBy("doc_id").agg(F.ceil(F.count("*") / ASKED).alias("many"))
    salt = F.pmod(F.xxhash64(*_CANDIDATE, "side"), "many").alias("salt")
    asked = sides.join(many, "doc_id").groupBy("doc_id", salt).agg(F.collect_list(F.struct(*_CANDIDATE, "side", "s", "e")).alias("asked"))

    def read(batches):
        """The tokens of the asked stretches; 32 bits of each are enough to compare two of them."""
        names = [*_CANDIDATE, "side"]
        for step in steps(batches):
            _, tokens, at = _tokens(step.column("text"))
            tokens = tokens.astype(np.uint32)
            row = np.repeat(np.arange(step.num_rows), step.column("asked").value_lengths().to_numpy(zero_copy_only=False))
            stretch = step.column("asked").flatten()
            first, last = (stretch.field(c).to_numpy() for c in ("s", "e"))
            first = np.maximum(first, 0)
            begin, end = (np.minimum(at[row] + x, at[row + 1]) for x in (first, np.maximum(last + 1, 0)))
            found = [tokens[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(stretch.field(c) for c in names), step.column("text_key").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(found, pa.binary())],
                [*names, "text_key", "s", "tokens"],
            )

    def verify(batches):
        """Rows sorted by stretch and side: a stretch at the later document, and one at the earlier."""
        pairs: list[tuple] = []  # of documents, the text of the later and where the stretches begin
        sides: tuple[list[bytes], list[bytes]] = ([], [])
        held: list[tuple] = []  # rows of the last stretch
        size = 0

        def several(rows):
            # repeated rows of a doc_id give the same stretch again; what is cut belongs to the text that holds it
            later, earlier = {}, {}
            for _, _, side, text, s, tokens in rows:
                if side == 0:
                    later[text, tokens] = s
                else:
                    earlier[tokens] = s
            for (text, b), from_b in later.items():
                for a, from_a in earlier.items():
                    add(rows[0][0], rows[0][1], text, from_b, from_a, b, a)

        def add(doc_b, doc_a, text, from_b, from_a, b, a):
            nonlocal size
            pairs.append((doc_b, doc_a, text, from_b, from_a))
            sides[0].append(b)
            sides[1].append(a)
            size += len(b) + len(a)

        def flush():
            nonlocal size
            lengths = np.array([[len(x) // 4 for x in side] for side in sides])
            most = 1 << (32 - max(int(lengths.max(initial=1) - 1).bit_length(), 1))
            for x in range(0, len(pairs), most):
                own = slice(x, x + most)
                arrays = [np.frombuffer(b"".join(side[own]), np.uint32) for side in sides]
                ats = [np.concatenate([[0], np.cumsum(n[own])]) for n in lengths]
                found = _verified(arrays[0], ats[0], arrays[1], ats[1], width, percent)
                doc_b, doc_a, text, from_b, from_a = np.array(pairs[own], np.int64)[found[:, 0]].T
                more = TOKEN_WORDS - 1
                yield _result(
                    [doc_b, from_b + found[:, 1], from_b + found[:, 2] + more, doc_a, from_a + found[:, 3], from_a + found[:, 4] + more, found[:, 5] / found[:, 6], text]
                )
            pairs.clear()
            sides[0].clear()
            sides[1].clear()
            size = 0

        last = None
        for step in steps(batches, "tokens", HELD):
            key = np.stack([step.column(c).to_numpy().astype(np.int64) for c in _CANDIDATE], axis=1)
            side = step.column("side").to_numpy()
            columns = [step.column(c).to_pylist() for c in ("doc_b", "doc_a", "side", "text_key", "s", "tokens")]
            begin = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            if last is not None and last == tuple(key[0]):
                held += zip(*(c[: begin[1]] for c in columns))
                begin = begin[1:]
            if len(begin) > 1:  # another stretch has begun
                several(held)
                plain = begin[1:-1] - begin[:-2] == 2
                plain &= (side[begin[:-2]] == 0) & (side[np.minimum(begin[:-2] + 1, len(side) - 1)] == 1)
                _, _, _, texts, starts, tokens = columns
                for i, one in zip(begin[:-2].tolist(), plain.tolist()):
                    if one:
                        add(columns[0][i], columns[1][i], texts[i], starts[i], starts[i + 1], tokens[i], tokens[i + 1])
                for i, j, one in zip(begin[:-2].tolist(), begin[1:-1].tolist(), plain.tolist()):
                    if not one:
                        several([*zip(*(c[i:j] for c in columns))])
                held = [*zip(*(c[begin[-2] :] for c in columns))]
                last = tuple(key[-1])
            if size > 2 * HELD:
                yield from flush()
        several(held)
        if pairs:
            yield from flush()

    def _result(columns):
        names = ["doc_id", "from_word", "to_word", "of_doc_id", "of_from_word", "of_to_word", "similarity", "text_key"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    n = parts(spark)
    spans = asked.join(keyed, "doc_id").select("asked", "text", "text_key").mapInArrow(read, "doc_b long, s_b int, e_b int, doc_a long, s_a int, e_a int, side int, text_key long, s int, tokens binary")
    met = spans.repartition(n, *_CANDIDATE).sortWithinPartitions(*_CANDIDATE, "side")
    schema = "doc_id long, from_word long, to_word long, of_doc_id long, of_from_word long, of_to_word long, similarity double, text_key long"
    return met.mapInArrow(verify, schema)


def cut_passages(docs: DataFrame, least_words: int = 50, percent: int = 80) -> DataFrame:
    """``docs`` with each repeated passage taken out of all documents but the earliest, and ``n_chars`` set anew.

    A document of which no word is left goes. Documents without words to begin with, and rows without ``doc_id``, stay.
    Where rows of one ``doc_id`` differ in their text, each loses its own passages. Further columns may have any names.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "passages")
    with scratch_scope(spark):
        repeated_passages(docs, least_words, percent).write.parquet(path)
    schema = docs.schema
    names = docs.columns
    found, key = free_name(names, "spans"), free_name(names, "text_key")
    spans = spark.read.parquet(path).groupBy("doc_id", F.col("text_key").alias(key)).agg(F.collect_set(F.struct("from_word", "to_word")).alias(found))

    def cut(batches):
        for step in steps(batches):
            words = Words(step.column("text"))
            texts, stay = [], np.ones(step.num_rows, bool)
            for i, spans in enumerate(step.column(found).to_pylist()):
                a, b = words.offsets[i], words.offsets[i + 1]
                raw = words.data[words.text_at[i] : words.text_at[i + 1]]
                gone = np.zeros(len(raw), bool)
                kept = np.ones(b - a, bool)
                for span in spans:
                    x, y = a + span["from_word"], min(a + span["to_word"], b - 1)
                    kept[span["from_word"] : span["to_word"] + 1] = False
                    # with the separators that follow, up to the next word
                    end = words.starts[y + 1] if y + 1 < b else words.text_at[i + 1]
                    gone[words.starts[x] - words.text_at[i] : end - words.text_at[i]] = True
                stay[i] = kept.any()
                texts.append(raw[~gone].tobytes().decode())
            columns = {c: step.column(c) for c in names}
            columns["text"] = pa.array(texts, step.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts]).cast(step.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stay))

    marked = docs.withColumn(key, text_key(F.col("text"))).join(spans, ["doc_id", key], "left").select(*names, found)
    changed = marked.where(F.col(found).isNotNull()).mapInArrow(cut, schema)
    return changed.unionByName(marked.where(F.col(found).isNull()).select(*names))
