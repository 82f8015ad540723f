"""Personal data in text: fixed patterns, extended by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices

KINDS = ["email", "ip", "card", "phone"]  # label 0 is none of them
LABELS = 1 + len(KINDS)
# fixed values: the base patterns; a run cannot match from inside when it does not from its start
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARK = re.compile(r"[0-9@]")
REST = re.compile(r"\S*")
TRAIN_DOCUMENTS = 4000  # documents with a node that the field is fitted on, about
CONTEXT = 128  # hashed neighbouring words
SHAPES = 48
FEATURES = SHAPES + 2 * CONTEXT
SURE = 0.9  # marginal probability from which a token joins a kind
ROUNDS = 12  # of message passing
EDGE = "()[]{}<>,;:.!?\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in order of start and kind, in code points."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def node_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens between blanks that hold a digit or an at-sign; every character is looked at a few times at most."""
    found, last = [], 0
    mark = MARK.search(text)
    while mark:
        start = mark.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = REST.match(text, mark.end()).end()
        found.append((start, last))
        mark = MARK.search(text, last)
    return found


class Graph:
    """The tokens of a text that hold a digit or an at-sign, with their features and edges.

    Every other token is certainly outside, so the chain falls into the stretches between them.
    Chain edges join neighbouring tokens; skip edges join each token to the next one in the text
    with the same form, the same digits (five or more) or the same part before an at-sign, however
    distant.  Consecutive occurrences are joined, not all pairs, so edges grow with the tokens.
    """

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        nodes = node_spans(text)
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        last: dict[tuple[str, str], int] = {}
        for i, (begin, end) in enumerate(nodes):
            token = text[begin:end]
            core = token.strip(EDGE)
            start = begin + token.find(core) if core else begin
            self.spans.append((start, start + len(core) if core else end))
            before, after = text[max(0, begin - 24):begin].split()[-1:], text[end:end + 24].split()[:1]
            self.features.append(self._features(core or token, (before or [""])[0], (after or [""])[0]))
            if i and not text[nodes[i - 1][1]:begin].strip():
                self.chain.append((i - 1, i))
            digits = "".join(c for c in core if c in "0123456789")
            forms = [("form", core.lower())] + [("digits", digits)] * (len(digits) >= 5) + [("local", core.lower().split("@")[0])] * ("@" in core[1:])
            linked = set()
            for form in forms:
                if form in last and last[form] not in linked:
                    linked.add(last[form])
                    self.skip.append((last[form], i))
                last[form] = i
        self.labels = np.zeros(len(nodes), np.int64)
        at = 0
        for start, kind, end in spans:
            while at < len(self.spans) and self.spans[at][1] <= start:
                at += 1
            for j in range(at, len(self.spans)):
                if self.spans[j][0] >= end:
                    break
                self.labels[j] = kind + 1

    @staticmethod
    def _features(core: str, before: str, after: str) -> list[int]:
        digits = sum(c in "0123456789" for c in core)
        letters = sum(c.isalpha() for c in core)
        shape = [0, 1 + min(digits, 19), 21 + min(core.count("."), 4), 26 + min(core.count("-"), 4), 31 + min(letters, 3)]
        shape += [35] * core.startswith("+") + [36] * ("(" in core) + [37] * ("@" in core[1:]) + [38] * core.startswith("@")
        shape += [39] * ("." in core.split("@")[-1]) + [40] * (len(core) > 24) + [41] * core.isdigit() + [42] * before.startswith("+")
        word = [SHAPES + zlib.crc32(before.lower().strip(EDGE).encode("utf-8", "replace")) % CONTEXT]
        return shape + word + [SHAPES + CONTEXT + zlib.crc32(after.lower().strip(EDGE).encode("utf-8", "replace")) % CONTEXT]


class Field:
    """Node weights and the log potentials of chain and skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of every node by loopy sum-product messages; base labels are given."""
        n = len(graph.features)
        unary = np.stack([self.weights[f].sum(axis=0) for f in graph.features])
        known = np.flatnonzero(graph.labels)
        unary[known] = -60.0
        unary[known, graph.labels[known]] = 0.0
        edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        unary -= unary.max(axis=1, keepdims=True)
        if len(edges):
            pair = np.exp(np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)]))
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(source), LABELS))  # in logarithms
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                rest = belief[source] - message[back]
                rest -= rest.max(axis=1, keepdims=True)
                new = np.log(np.einsum("ei,eij->ej", np.exp(rest), potential) + 1e-30)
                message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            np.add.at(unary, target, message)
        unary = np.exp(unary - unary.max(axis=1, keepdims=True))
        return unary / unary.sum(axis=1, keepdims=True) if n else unary


def _association(pairs: np.ndarray) -> np.ndarray:
    """Log ratio of the joint frequency of two labels to the product of their own."""
    joint = pairs + pairs.T + 0.5
    joint = joint / joint.sum()
    return np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))


def fit(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> Field:
    """Piecewise training: node weights, chain and skip potentials are each fitted to the base labels.

    The documents are drawn by a hash of the text among those with a node; features return as counts
    of equal rows.  Without any, the field adds nothing.
    """
    nodes = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    share = min(1_000_000, most * 1_000_000 // max(nodes.count(), 1) + 1)
    sample = nodes.where(F.pmod(F.xxhash64(F.lit("field"), "text"), F.lit(1_000_000)) < share)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[tuple, int] = {}
            for text in batch.column("text").to_pylist():
                graph = Graph(text, base_spans(text))
                for f, y in zip(graph.features, graph.labels.tolist(), strict=True):
                    rows[(0, y, *f)] = rows.get((0, y, *f), 0) + 1
                for kind, edges in ((1, graph.chain), (2, graph.skip)):
                    for i, j in edges:
                        if kind == 2 and (graph.labels[i] == 0) != (graph.labels[j] == 0):
                            continue  # a base pattern saw one form only: the other's label is unknown
                        key = (kind, int(graph.labels[i]), int(graph.labels[j]))
                        rows[key] = rows.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in rows], pa.list_(pa.int32())), pa.array(list(rows.values()), pa.int64())],
                                             names=["row", "n"])

    counted = sample.mapInArrow(collect, "row array<int>, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((3, LABELS, LABELS))
    features, labels, counts = [], [], []
    for row, n in sorted(zip(counted["row"].to_pylist(), counted["n"].to_pylist(), strict=True)):
        if row[0]:
            pairs[row[0], row[1], row[2]] += n
        else:
            features.append(row[2:])
            labels.append(row[1])
            counts.append(n)
    weights = np.zeros((FEATURES, LABELS))
    if features:
        table = np.zeros((len(features), FEATURES), np.float32)
        for i, f in enumerate(features):
            table[i, f] = 1
        wanted, heft = np.eye(LABELS)[labels], np.array(counts)[:, None] / sum(counts)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, 301):
            z = table @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            slope = table.T @ (heft * (p / p.sum(axis=1, keepdims=True) - wanted)) + 1e-5 * weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    else:
        weights[:, 0] = 20.0
    return Field(weights, _association(pairs[1]), _association(pairs[2]))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field is sure of and that touch no base span; neighbours of one kind join."""
    graph = Graph(text, base)
    if not graph.features:
        return []
    marginal = field.marginals(graph)
    chained = {j for i, j in graph.chain}
    found: list[list[int]] = []
    previous = -2
    for i in np.flatnonzero((graph.labels == 0) & (marginal[:, 0] <= 1 - SURE)).tolist():
        kind = int(marginal[i, 1:].argmax())
        if marginal[i, kind + 1] < SURE:
            continue
        start, end = graph.spans[i]
        if previous == i - 1 and i in chained and found and found[-1][1] == kind:
            found[-1][2] = end
        else:
            found.append([start, kind, end])
        previous = i
    return [(s, k, e) for s, k, e in found]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans (base and added).

    A null or empty text has no spans.  Every row is judged alone by its whole text, so repeated rows
    agree; extra columns are ignored.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = added_spans(text, base, field) if text else []
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    slim = docs.select("doc_id", "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return slim.mapInArrow(judge, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")
