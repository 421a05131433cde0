"""Operator 5: SentencePiece encoding and decoding with segmentations sampled without replacement."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import keep, slices
from .shingles import U, mix

SPACE = "▁"
NONE = -np.inf


class Pieces:
    """The vocabulary of a model file with log weights: Zipf's law over the merge ranks, -log(rank + 1).

    Characters outside of it are spelt in byte pieces (ids ``bytes_at`` + byte); such a character has the id
    ``size`` + code point while a lattice is searched.
    """

    BYTE_LOG = -12.0

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.text = [self.model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.bytes_at = next(i for i in range(self.size) if self.model.is_byte(i))
        #: Where no piece holds a letter next to anything but a letter, words and signs are chunks of their own.
        self.pattern = SPACED if any(CROSSED.search(self.text[i]) for i in plain) else WORDS
        self.log = np.full(self.size, NONE)
        for rank, i in enumerate(plain, 1):
            self.log[i] = -np.log(rank + 1.0)
        #: For each length in characters: sorted hashes of what pieces begin with, and the piece it is (-1: none).
        by: dict[int, dict[int, int]] = {}
        for i in plain:
            h = 0
            for n, c in enumerate(self.text[i], 1):
                h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                level = by.setdefault(n, {})
                if n == len(self.text[i]):
                    level[h] = i
                else:
                    level.setdefault(h, -1)
        self.table = {n: (np.array(sorted(x), np.uint64), np.array([x[h] for h in sorted(x)])) for n, x in by.items()}
        self.longest = max(self.table)
        self.raw = [bytes([i - self.bytes_at]) if self.bytes_at <= i < self.bytes_at + 256 else self.text[i].encode() for i in range(self.size)]

    def spell(self, found: np.ndarray) -> np.ndarray:
        """Ids with characters outside the vocabulary put into byte pieces."""
        odd = found >= self.size
        if not odd.any():
            return found
        if (found[odd] < self.size + 128).all():
            return np.where(odd, found - self.size + self.bytes_at, found)
        out = []
        for x in found.tolist():
            out += [x] if x < self.size else [self.bytes_at + b for b in chr(x - self.size).encode("utf-8", "surrogatepass")]
        return np.asarray(out, np.int64)

    def decode(self, ids) -> str:
        """Text of a sequence of pieces; the space that encoding puts in front is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


LETTER = "[^\\W\\d_²³¹¼½¾]"
CROSSED = re.compile(f"{LETTER}(?!{SPACE}|{LETTER})[^\\n]|(?!{SPACE}|{LETTER})[^\\n]{LETTER}")
WORDS = re.compile(f"\\n|{SPACE}*{LETTER}+|{SPACE}*(?:(?!{LETTER})[^{SPACE}\\n])+|{SPACE}+")
#: The same for texts of these characters, whose letters are quickly told.
LATIN = re.compile("[\\t\\n -~À-ÿ]*")
LATIN_WORDS = re.compile(WORDS.pattern.replace(LETTER, "[A-Za-zÀ-ÖØ-öø-ÿ]"))
SPACED = re.compile(f"\\n|{SPACE}*[^{SPACE}\\n]+|{SPACE}+")
LONGEST = 4096  # characters of a chunk


def chunks_of(text: str, pattern: re.Pattern = SPACED) -> list[str]:
    """Stretches that no piece crosses, in order; spaces in front of a word belong to it, and the text gets one too.

    A stretch of more than ``LONGEST`` characters is cut every so many, so that no lattice is larger.
    """
    if pattern is WORDS and LATIN.fullmatch(text):
        pattern = LATIN_WORDS
    found = pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []
    if len(text) < LONGEST or max(map(len, found), default=0) <= LONGEST:
        return found
    return [c[at : at + LONGEST] for c in found for at in range(0, len(c), LONGEST)]


class Lattices:
    """Lattices of the chunks met, one node for each character, in flat arrays; bounded by ``limit`` edges.

    ``cum`` holds node + cumulative probability of its edges given the node (backward log-sums normalise them),
    so that a few vector steps from a node's first edge on draw an edge of every node of a batch.
    """

    def __init__(self, pieces: Pieces, limit: int = 12_000_000):
        self.pieces, self.limit = pieces, limit
        room = limit + limit // 4  # asked for once; pages are taken as they fill
        self.cum, self.logp = np.empty(room), np.empty(room, np.float32)
        self.next, self.piece = np.empty(room, np.int32), np.empty(room, np.int32)
        self.final, self.first = np.zeros(room, bool), np.zeros(room, np.int32)
        #: For each node the log of what its edges but a likely one (above 0.5) have in all, exact however little that is.
        self.others = np.full(room, NONE, np.float32)
        self.reset()

    def reset(self) -> None:
        self.start: dict[str, int] = {}
        self.nodes, self.edges = 0, 0

    def _grow(self, edges: int, nodes: int) -> None:
        for names, size in ((("cum", "logp", "next", "piece"), edges), (("final", "first", "others"), nodes)):
            for name in names:
                a = getattr(self, name)
                if size > len(a):
                    setattr(self, name, np.concatenate([a, np.empty(size + size // 4 - len(a), a.dtype)]))

    def add(self, chunks: list[str]) -> None:
        p = self.pieces
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(code))  # characters up to the chunk's end
        at = np.arange(len(code)) + np.repeat(np.arange(len(chunks)), lengths)  # node numbers: one more node a chunk
        total = len(code) + len(chunks)
        h = np.zeros(len(code), np.uint64)
        src, dst, ids, logs = [], [], [], []
        live = np.arange(len(code))
        with np.errstate(over="ignore"):
            for n in range(1, p.longest + 1):
                live = live[left[live] >= n]
                if not len(live):
                    break
                h[live] = h[live] * U(0x100000001B3) + code[live + n - 1] + U(1)
                keys, found = p.table[n]
                i = np.minimum(np.searchsorted(keys, h[live]), len(keys) - 1)
                begun = keys[i] == h[live]
                piece = np.where(begun, found[i], -1)
                ok = piece >= 0
                src.append(live[ok])
                ids.append(piece[ok])
                logs.append(p.log[ids[-1]])
                dst.append(at[live[ok]] + n)
                single = live
                live = live[begun]
                if n == 1:
                    odd = single[~ok]
                    src.append(odd)
                    ids.append(p.size + code[odd].astype(np.int64))
                    c = code[odd]
                    logs.append(p.BYTE_LOG * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                    dst.append(at[odd] + 1)
        # Longest first, as long pieces are likely ones: few steps find the drawn edge of a node.
        src, dst, ids, logs = (np.concatenate(x[::-1]) for x in (src, dst, ids, logs))
        # Backward sums, all chunks at once, from the characters next to the ends outwards.
        order = np.argsort(left[src] * len(code) + src, kind="stable")
        away = left[src[order]]
        cuts = np.searchsorted(away, np.arange(1, int(left.max(initial=0)) + 2))
        beta = np.zeros(total)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            e = order[lo:hi]
            v = logs[e] + beta[dst[e]]
            s = src[e]
            heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(v, heads)
            wide = np.repeat(top, np.diff([*heads, len(e)]))
            beta[at[s[heads]]] = top + np.log(np.add.reduceat(np.exp(v - wide), heads))
        cond = logs + beta[dst] - beta[at[src]]
        order = np.argsort(src, kind="stable")
        src, dst, ids, cond = src[order], dst[order], ids[order], cond[order]
        prob = np.exp(cond)
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        run = np.cumsum(prob)
        within = run - np.repeat(run[heads] - prob[heads], np.diff([*heads, len(src)]))
        within[np.concatenate([heads[1:] - 1, [len(src) - 1]])] = 1.0
        n, m = self.edges + len(src), self.nodes + total
        self._grow(n, m)
        with np.errstate(divide="ignore"):
            unlikely = np.log(np.add.reduceat(np.where(prob > 0.5, 0.0, prob), heads))
        self.others[self.nodes + at[src[heads]]] = np.maximum(unlikely, NONE)
        new = slice(self.edges, n)
        self.cum[new] = at[src] + self.nodes + np.minimum(within, 1.0)
        self.logp[new], self.next[new], self.piece[new] = np.minimum(cond, 0), dst + self.nodes, ids
        self.final[self.nodes : m] = False
        self.final[self.nodes + ends + np.arange(len(chunks))] = True
        self.first[self.nodes + at[src[heads]]] = heads + self.edges
        begin = self.nodes + np.concatenate([[0], ends[:-1] + np.arange(1, len(chunks))])
        self.start.update(zip(chunks, begin.tolist(), strict=True))
        self.nodes, self.edges = m, n

    def nodes_of(self, chunks: list[str]) -> np.ndarray:
        part, size = [], 0
        for c in set(chunks).difference(self.start):
            part.append(c)
            size += len(c)
            if size > 200_000:  # what a step of building holds besides the store
                self.add(part)
                part, size = [], 0
        if part:
            self.add(part)
        return np.fromiter(map(self.start.__getitem__, chunks), np.int32, len(chunks))


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def walk(lat: Lattices, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path from each node to its chunk's end: ``(start index, edge)``, ordered by start index and step."""
    cum, nxt, final, first = lat.cum, lat.next, lat.final, lat.first
    who, edges = [], []
    live = np.flatnonzero(~final[node])
    at = node[live]
    step = 0
    while len(live):
        u = uniform(key[live] + U(step * 0xD1342543DE82EF95 % 2**64))
        u += at
        e = first[at]
        behind = np.flatnonzero(cum[e] <= u)
        while len(behind):
            e[behind] += 1
            behind = behind[cum[e[behind]] <= u[behind]]
        who.append(live)
        edges.append(e)
        at = nxt[e]
        go = ~final[at]
        live, at = live[go], at[go]
        step += 1
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    who, edges = np.concatenate(who), np.concatenate(edges)
    order = np.argsort(who, kind="stable")
    return who[order], edges[order]


def gumbel_below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest perturbed value of a set of log mass ``mass``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        m = np.where(np.isfinite(mass), mass, 0)
        out = m - np.log(np.exp(np.minimum(m - bound, 700)) - np.log(u))
    return np.where(np.isfinite(mass), np.minimum(out, bound), NONE)


def log_rest(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Log of the probability that a node's other edges have; for likely edges from their own sum, not from 1 - p."""
    p = np.exp(lat.logp[edges].astype(np.float64))
    node = np.ceil(lat.cum[edges]).astype(np.int64) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0.5, lat.others[node].astype(np.float64), np.log1p(-np.minimum(p, 0.5)))


def log_inclusion(logp: float, bar: float) -> float:
    """log P(perturbed value above ``bar``) for an outcome of log probability ``logp``."""
    if bar == NONE:
        return 0.0
    x = logp - bar
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


class Sampled:
    """A path of one text and the regions that split off it: at each edge from ``since`` on, all other edges."""

    __slots__ = ("edges", "chunk", "logs", "value", "best", "since", "banned", "regions")


def sample_texts(lat: Lattices, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations ``(ids, log_prob, perturbed, log_inclusion)``, best first.

    This is A* over the tree of prefixes with perturbed log probabilities: the largest perturbed value of a region
    is a Gumbel variable with the region's log mass, below that of the region it came from, so the next best
    segmentation lies in the region with the largest value; it is drawn there and splits the region along its
    path.  Masses are exact, as each node's edges are normalised by backward sums.
    """
    lists = [chunks_of(t, lat.pieces.pattern) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    node = lat.nodes_of([c for x in lists for c in x])
    base = mix(np.array([x % 2**64 for x in keys], np.uint64))
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        key = mix(base[doc] + (place.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
        who, edges = walk(lat, node, key)
        logs = lat.logp[edges].astype(np.float64)
        of = doc[who]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        top = -np.log(-np.log(uniform(base + U(77))))
        before = np.cumsum(logs) - logs
        begin = np.where(cuts[:-1] < len(before), before[np.minimum(cuts[:-1], max(0, len(before) - 1))], 0) if len(before) else np.zeros(len(texts))
        mass = before - begin[of] + log_rest(lat, edges)
        draws = uniform(base[of] + (np.arange(len(of)) - cuts[:-1][of] + 1).astype(np.uint64) * U(0xA24BAED4963EE407)) if len(of) else logs
        values = gumbel_below(mass, top[of], draws)
    first_of = np.cumsum(counts) - counts
    out = []
    todo = []
    for d in range(len(texts)):
        lo, hi = cuts[d], cuts[d + 1]
        s = Sampled()
        s.edges, s.chunk, s.logs = edges[lo:hi], who[lo:hi] - first_of[d], logs[lo:hi]
        s.value, s.since, s.banned, s.regions = float(top[d]), 0, {}, values[lo:hi].copy()
        todo.append([s])
    for number in range(2, k + 1):
        starts, start_keys, plans = [], [], []
        for d, found in enumerate(todo):
            if len(found) < number - 1:
                continue
            best = max(found, key=lambda s: s.regions.max(initial=NONE))
            if best.regions.max(initial=NONE) == NONE:
                continue
            j = int(best.regions.argmax())
            value = float(best.regions[j])
            best.regions[j] = NONE
            banned = best.banned.get(j, ()) + (int(best.edges[j]),)
            inner = j > 0 and best.chunk[j - 1] == best.chunk[j]
            at = int(lat.next[best.edges[j - 1]] if inner else node[first_of[d] + best.chunk[j]])
            first = last = int(lat.first[at])
            while True:
                if lat.cum[last] >= at + 1.0:
                    break
                last += 1
            p = np.exp(lat.logp[first : last + 1].astype(np.float64))
            p[[b - first for b in banned]] = 0
            with np.errstate(over="ignore"):
                u = float(uniform(base[d : d + 1] + U((number * 0xC2B2AE3D27D4EB4F) % 2**64))[0])
            run = np.cumsum(p)
            e = first + int(np.searchsorted(run, u * run[-1], side="right"))
            e = min(e, last)
            while e - first > 0 and p[e - first] == 0:
                e -= 1
            p[e - first] = 0
            left = math.log(p.sum()) if p.any() else NONE
            c = int(best.chunk[j])
            rest = node[first_of[d] + c + 1 : first_of[d] + counts[d]]
            starts.append(np.concatenate([[lat.next[e]], rest]).astype(np.int32))
            with np.errstate(over="ignore"):
                start_keys.append(mix(base[d] + (np.arange(c, counts[d], dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) + U((number << 48) % 2**64)))
            plans.append((d, best, j, e, c, value, banned, left))
        if not plans:
            break
        who, edges = walk(lat, np.concatenate(starts), np.concatenate(start_keys))
        offs = np.cumsum([0, *(len(x) for x in starts)])
        cuts = np.searchsorted(who, offs)
        for i, (d, parent, j, e, c, value, banned, left) in enumerate(plans):
            lo, hi = cuts[i], cuts[i + 1]
            s = Sampled()
            s.edges = np.concatenate([parent.edges[:j], [e], edges[lo:hi]])
            s.chunk = np.concatenate([parent.chunk[:j], [c], who[lo:hi] - offs[i] + c])
            s.logs = lat.logp[s.edges].astype(np.float64)
            s.value, s.since, s.banned = value, j, {j: banned}
            before = np.cumsum(s.logs) - s.logs
            rest = log_rest(lat, s.edges)
            rest[j] = left
            mass = before + rest
            mass[:j] = NONE
            with np.errstate(over="ignore"):
                draws = uniform(base[d] + U((number * 0x165667B19E3779F9) % 2**64) + np.arange(1, len(mass) + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))
            s.regions = gumbel_below(mass, np.full(len(mass), value), draws)
            todo[d].append(s)
    for found in todo:
        bar = max(s.regions.max(initial=NONE) for s in found)
        rows = []
        for s in found:
            logp = float(s.logs.sum())
            rows.append((lat.pieces.spell(lat.piece[s.edges].astype(np.int64)), logp, s.value, log_inclusion(logp, bar)))
        out.append(rows)
    return out


def lattices(path: str) -> Lattices:
    """The lattices of this Python worker, kept from task to task."""
    return keep(("pieces", path), lambda: Lattices(Pieces(path)))


SCHEMA = "_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, restored boolean"


def _sample(path: str, k: int, seed: int, with_ids: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path)
        for batch in (x for b in batches for x in slices(b)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size < 300_000):
                    size += len(texts[end] or "")
                    end += 1
                part = [t or "" for t in texts[at:end]]
                keys = [xxhash.xxh3_64_intdigest(f"{seed}/{i}") for i in ids[at:end]]
                rows = []
                raw = lat.pieces.raw.__getitem__
                for i, text, found in zip(ids[at:end], part, sample_texts(lat, part, keys, k), strict=True):
                    # what decoding must give, before spaces are put back; a space mark of the text's own would become one
                    marked = (SPACE + text.replace(" ", SPACE)).encode("utf-8", "surrogatepass") if text else b""
                    plain = SPACE not in text
                    for n, (pieces, logp, value, inclusion) in enumerate(found, 1):
                        restored = plain and b"".join(map(raw, pieces.tolist())) == marked
                        row = (i, n, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), logp, value, inclusion, restored)
                        rows.append((*row, pieces.tolist()) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                if lat.edges > lat.limit:
                    lat.reset()
                at = end

    return run


def sample_segmentations(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 17, with_ids: bool = False
) -> DataFrame:
    """``docs`` -> up to ``k`` rows each: ``(id, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, restored[, ids])``.

    Distinct segmentations of the whole text, drawn without replacement in order of their perturbed log
    probability; the random numbers depend on ``seed`` and the row's id alone, so a retried task draws the same.
    ``log_inclusion`` is the log probability of being above the best segmentation left out.  ``restored`` tells
    whether decoding gives the text back (not so where the text holds the space mark itself).  One pass over the scan,
    nothing shuffled, memory bounded by a batch of texts and a bounded store of lattices.  Null and empty texts have
    the one empty segmentation; a text with fewer than ``k`` segmentations gives all it has; repeated rows give
    equal results; null ids share one seed; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = SCHEMA + ", ids array<int>" * with_ids
    return rows.mapInArrow(_sample(model_path, k, seed, with_ids), schema).withColumnRenamed("_id", id_col)
