"""Quote-aware finite-state tokenizer for delimited records, over whole columns of bytes at once.

A dialect is a transition table over byte classes.  The bytes of all records of a batch are one stream, each
record followed by an end mark.  The stream is cut into chunks of equal length regardless of records; each
chunk gives the map from every start state to its end state, without knowing where it starts; the maps are
composed from left to right, which gives each chunk's true start state; a second pass then labels each byte.
The same composition joins chunks of one file that were read by different tasks (see transition_map).
"""

from __future__ import annotations

import numpy as np

# byte classes
OTHER, BLANK, SEP, QUOTE, END = range(5)
# states of dialect "csv": before a field, in a bare field, in quotes, after a quote in quotes, after the field, broken
START, BARE, QUOTED, CLOSING, CLOSED, BROKEN = range(6)
CHUNK = 128


def csv_table() -> np.ndarray:
    """Quoted fields with doubled quotes; blanks round fields do not count; broken stays to the record's end."""
    t = np.full((6, 5), BROKEN, dtype=np.uint8)
    t[:, END] = START
    t[[START, BARE, CLOSING, CLOSED], SEP] = START
    t[START, [OTHER, BLANK, QUOTE]] = BARE, START, QUOTED
    t[BARE, [OTHER, BLANK]] = BARE
    t[QUOTED, [OTHER, BLANK, SEP, QUOTE]] = QUOTED, QUOTED, QUOTED, CLOSING
    t[CLOSING, [BLANK, QUOTE]] = CLOSED, QUOTED
    t[CLOSED, BLANK] = CLOSED
    return t


def stream_table() -> np.ndarray:
    """As csv, for raw files: END is a line end, which within quotes belongs to the field."""
    t = csv_table()
    t[QUOTED, END] = QUOTED
    return t


def parity_table() -> np.ndarray:
    """Quotes only have to be even within a field; separators always separate."""
    t = np.full((6, 5), BROKEN, dtype=np.uint8)
    t[[START, QUOTED], :] = np.array([[START, START, START, QUOTED, START], [QUOTED, QUOTED, BROKEN, START, START]], dtype=np.uint8)
    t[BROKEN, END] = START
    return t


def classes(sep: str) -> np.ndarray:
    c = np.zeros(256, dtype=np.uint8)
    c[[ord(" "), ord("\t")]] = BLANK
    c[ord(sep)] = SEP
    c[ord('"')] = QUOTE
    return c


def chunk_maps(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """End state of each start state over each row of byte classes: (rows, states)."""
    maps = np.broadcast_to(np.arange(table.shape[0], dtype=np.uint8), (len(grid), table.shape[0])).copy()
    for k in range(grid.shape[1]):
        maps = table[maps, grid[:, k][:, None]]
    return maps


def transition_map(table: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """End state of each start state over a run of byte classes."""
    whole = len(cls) // CHUNK * CHUNK
    state = np.arange(table.shape[0], dtype=np.uint8)
    for m in chunk_maps(table, cls[:whole].reshape(-1, CHUNK)):
        state = m[state]
    for c in cls[whole:]:
        state = table[state, c]
    return state


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The map of two runs one after the other."""
    return then[first]


def label(table: np.ndarray, cls: np.ndarray, start: int = START) -> tuple[np.ndarray, int]:
    """State before each byte of the stream, and the state after all of it."""
    n = len(cls)
    if not n:
        return np.empty(0, np.uint8), start
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, OTHER, dtype=np.uint8)
    grid[:n] = cls
    grid = grid.reshape(rows, CHUNK)
    maps = chunk_maps(table, grid)
    begins = np.empty(rows, dtype=np.uint8)
    state = start
    for r, m in enumerate(maps.tolist()):
        begins[r] = state
        state = m[state]
    before = np.empty((rows, CHUNK), dtype=np.uint8)
    now = begins
    for k in range(CHUNK):
        before[:, k] = now
        now = table[now, grid[:, k]]
    before = before.ravel()[:n]
    return before, int(table[before[-1], cls[-1]])


def tokenize(data: np.ndarray, offsets: np.ndarray, sep: str, dialect: str = "csv") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fields of records given as one byte array and n + 1 offsets.

    Returns (first field of each record, n + 1 long; field starts; field ends; error offset of each record or
    -1; whether the record's last field was left open).  Ends exclude the separator; offsets count bytes from
    the record's start.
    """
    table = csv_table() if dialect == "csv" else parity_table()
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    where = offsets[:-1] - offsets[0] + np.arange(n)  # each record is one longer by its end mark
    total = int(lengths.sum()) + n
    cls = np.full(total, END, dtype=np.uint8)
    body = np.ones(total, dtype=bool)
    ends = where + lengths
    body[ends] = False
    cls[body] = classes(sep)[data[offsets[0] : offsets[-1]]]
    before, _ = label(table, cls)
    after = table[before, cls]
    record = np.repeat(np.arange(n), lengths + 1)
    broke = np.flatnonzero((after == BROKEN) & (before != BROKEN))
    error = np.full(n, -1, dtype=np.int64)
    first = np.unique(record[broke], return_index=True)
    error[first[0]] = broke[first[1]] - where[first[0]]
    open_end = before[ends] == QUOTED
    error = np.where((error < 0) & open_end, lengths, error)
    cut = np.flatnonzero((cls == END) | ((cls == SEP) & (after == START)))
    count = np.bincount(record[cut], minlength=n)
    field_first = np.concatenate([[0], np.cumsum(count)])
    starts = np.empty(len(cut), dtype=np.int64)
    if len(cut):
        starts[1:] = cut[:-1] + 1
        starts[0] = 0
    own = record[cut]
    return field_first, starts - where[own], cut - where[own], error, open_end
