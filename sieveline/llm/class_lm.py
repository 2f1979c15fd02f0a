"""LM scoring with Brown class-based n-grams.

Every word is in one class; a text's probability is the product of class-transition
probabilities and of word-emission probabilities in the class. Classes come from
exchange clustering of units: every word that training has at least ``FREQUENT``
times and at least once in 1 / ``SHARE`` words (and in any case the ``TOP`` most
frequent words), and for rarer and unseen words the bucket of their last bytes. A
share bounds the units: no more than 1 / ``SHARE`` words can have it. The unit
bigrams of all training texts are a table. One task clusters the top words and the
buckets; the other words start dealt over the classes (words that start in one class
can hold each other there); then all units move in rounds over that table, a part of
them at a time: a unit's counts by neighbouring class are summed in Spark and its
best class is found against the class bigrams of the round. A round that lowers the
likelihood is undone and smaller parts move; it ends when ``TURNS`` rounds raise the
likelihood by less than ``RISE`` of it.

Counts of words cover all training texts and stay distributed: the vocabulary is a
table, of which only the head (words above a count that at most ``HEAD`` reach, and
all words that are units) is broadcast. Head words are looked up where the text is
read; the words below are rare by construction, so a join of their counts by
document on the word has no hot key. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, documents, fold, prepare
from .training import fit_in_task

PARTS, HELD = 5, 1
HEAD, TOP, SUFFIXES, CLASSES, ROUNDS = 1 << 17, 1500, 512, 64, 3
#: Count and share of all words from which a word is a unit; parts that move in turn at first; rise of the likelihood that is worth more rounds.
FREQUENT, SHARE, TURNS, RISE = 50, 1e-6, 2, 3e-3
#: A unit's counts: classes after it, classes before it, itself after itself.
SLOTS = 2 * CLASSES + 1
#: Weight of the class unigram in a transition; entries a task gathers before it passes them on; unit bigrams in a row of their table.
PRIOR, GATHER, PACK = 5.0, 1 << 20, 1 << 17


def _suffix(words: K.Words) -> np.ndarray:
    low = words.data + np.where((words.data >= 65) & (words.data <= 90), 32, 0).astype(np.uint8)
    value = np.zeros(len(words.start), K.U64)
    for k in range(1, 4):
        at = words.end - k
        value = (value << K.U64(8)) | np.where(at >= words.start, low[np.maximum(at, 0)], 0).astype(K.U64)
    return (K.mix(value + K.U64(1)) % K.U64(SUFFIXES)).astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at, index = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return key, at, np.bincount(index, np.concatenate(counts), len(key)).astype(np.int64)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, s, c): the training words, their suffix bucket and count, gathered within the task."""
    keys: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(ends[0].astype(np.int32)), pa.array(counts[0])], names=["w", "s", "c"])

    for batch in K.slices(batches):
        words = K.Words(batch.column("text"))
        h = words.hashes(fold_case=True)
        keys.append(h), ends.append(_suffix(words)), counts.append(np.ones(len(h), np.int64))
        if sum(map(len, keys)) > GATHER:
            key, at, n = _merged(keys, counts)
            keys, ends, counts = [key], [np.concatenate(ends)[at]], [n]
            if len(key) > GATHER // 2:
                yield rows()
                keys, ends, counts = [], [], []
    if keys:
        key, at, n = _merged(keys, counts)
        keys, ends, counts = [key], [np.concatenate(ends)[at]], [n]
        yield rows()


def _units(head: dict, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of each word; whether it is in the head; its place there."""
    h = words.hashes(fold_case=True)
    at = np.minimum(np.searchsorted(head["w"], h), max(len(head["w"]) - 1, 0))
    known = head["w"][at] == h if len(head["w"]) else np.zeros(len(h), bool)
    unit = head["words"] + _suffix(words)
    if len(head["w"]):
        own = head["unit"][at]
        unit = np.where(known & (own >= 0), own, unit)
    return unit, known, at


def _sequences(unit: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units before and at each token, ends included, and the first token of each document."""
    n = len(first) - 1
    token_first = first + np.arange(n + 1)
    now = np.full(len(unit) + n, end)
    inner = np.ones(len(now), bool)
    inner[token_first[1:] - 1] = False
    now[inner] = unit
    before = np.empty(len(now), np.int64)
    before[1:] = now[:-1]
    before[token_first[:-1]] = end
    return before, now, token_first


def _summed(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(key, n) rows: counts by key, gathered within the task."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for key, n in chunks:
        keys.append(key), counts.append(n)
        if sum(map(len, keys)) > GATHER:
            key, _, n = _merged(keys, counts)
            keys, counts = [key], [n]
            if len(key) > GATHER // 2:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
                keys, counts = [], []
    if keys:
        key, _, n = _merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _bigrams(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = head.value["words"] + SUFFIXES + 1

        def chunks():
            for batch in K.slices(batches):
                words = K.Words(batch.column("text"))
                before, now, _ = _sequences(_units(head.value, words)[0], words.first, units - 1)
                yield np.unique(before * units + now, return_counts=True)

        yield from _summed(chunks())

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, n) as bytes of many: each round reads the whole table, and rows one by one cost most of a round."""
    waiting: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        found = pa.Table.from_batches(waiting)
        key, n = found["key"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(key)
        return pa.RecordBatch.from_arrays([pa.array([key[order].tobytes()], pa.binary()), pa.array([n[order].tobytes()], pa.binary())], names=["keys", "counts"])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) > PACK:
            yield row()
            waiting = []
    if waiting:
        yield row()


def _by_pair(shared, keys):
    """Counts by keys(a, b, n, value) of the unit bigrams (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value

        def chunks():
            for batch in batches:
                for one, many in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    pair, n = np.frombuffer(one, np.int64), np.frombuffer(many, np.int64)
                    yield keys(pair // value["units"], pair % value["units"], n, value)

        yield from _summed(chunks())

    return run


def _seed_pairs(a, b, n, m):
    return m["seed"][a] * (TOP + SUFFIXES + 1) + m["seed"][b], n


def _contexts(a, b, n, m):
    """Counts by unit and slot of the units whose turn it is; the end never moves."""
    turns, turn, end = m["turns"], m["turn"], m["units"] - 1
    loop = a == b
    moves_a, moves_b = (a % turns == turn) & (a != end), (b % turns == turn) & (b != end)
    left, right, own = moves_a & ~loop, moves_b & ~loop, m["own"].astype(np.int64)
    both = moves_a & loop
    keys = [a[left] * SLOTS + own[b[left]], b[right] * SLOTS + CLASSES + own[a[right]], a[both] * SLOTS + 2 * CLASSES]
    return np.concatenate(keys), np.concatenate([n[left], n[right], n[both]])


def _round(a, b, n, m):
    """The contexts, and counts by class pair under negative keys."""
    key, count = _contexts(a, b, n, m)
    own = m["own"].astype(np.int64)
    return np.concatenate([key, -1 - own[a] * CLASSES - own[b]]), np.concatenate([count, n])


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(key: np.ndarray, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and the class in which each raises the bigram likelihood most, all others held.

    key: unit * ``SLOTS`` + slot, sorted, each once; matrix: the class bigrams. The last class takes no unit.
    """
    size = len(matrix)
    unit, slot = key // SLOTS, key % SLOTS
    units, row = np.unique(unit, return_inverse=True)
    at = np.arange(len(units))
    old = own[units].astype(np.int64)
    counts = np.zeros((len(units), SLOTS))
    counts[row, slot] = n
    after, before, loop = counts[:, :CLASSES][:, :size], counts[:, CLASSES : 2 * CLASSES][:, :size], counts[:, -1]
    rows, cols = matrix.sum(1), matrix.sum(0)
    gain = np.zeros((len(units), size))
    known = {True: _f(matrix), False: _f(matrix.T)}
    for is_after, way, mine, other in ((True, matrix, after, before), (False, matrix.T, before, after)):
        # way[c, k]: class pairs that a unit in c with neighbours in k adds to
        mask = (slot < CLASSES) if is_after else (slot >= CLASSES) & (slot < 2 * CLASSES)
        r, k, x = row[mask], slot[mask] % CLASSES, n[mask].astype(float)
        base = way[:, k].T
        terms = _f(base + x[:, None]) - known[is_after][:, k].T
        # the unit is taken out of its old class first
        i = np.arange(len(r))
        terms[i, old[r]] = _f(base[i, old[r]]) - _f(base[i, old[r]] - x)
        same = np.flatnonzero(k == old[r])
        less = way[:, k[same]].T - other[r[same]]
        less[np.arange(len(same)), old[r[same]]] -= x[same] + loop[r[same]]
        terms[same] = _f(less + x[same][:, None]) - _f(less)
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else r
        gain[r[first]] += np.add.reduceat(terms, first, axis=0) if len(r) else 0.0
    diagonal = np.broadcast_to(np.diag(matrix), gain.shape).copy()
    diagonal[at, old] -= after[at, old] + before[at, old] + loop
    gain += _f(diagonal + after + before + loop[:, None]) - _f(diagonal + after) - _f(diagonal + before) + _f(diagonal)
    sum_a, sum_b = after.sum(1), before.sum(1)
    left, right = np.broadcast_to(rows, gain.shape).copy(), np.broadcast_to(cols, gain.shape).copy()
    left[at, old] -= sum_a + loop
    right[at, old] -= sum_b + loop
    gain -= _f(left + (sum_a + loop)[:, None]) - _f(left) + _f(right + (sum_b + loop)[:, None]) - _f(right)
    best = gain[:, : size - 1].argmax(1)
    return units, np.where(gain[at, best] > gain[at, old] + 1e-9, best, old)


def _moves(shared):
    """(unit, class) of the units that move, of (key, n) rows with each unit's rows together and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def moved(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            unit, best = best_classes(key, n, m["own"], m["matrix"])
            go = best != m["own"][unit]
            return pa.RecordBatch.from_arrays([pa.array(unit[go]), pa.array(best[go].astype(np.int32))], names=["unit", "class"])

        for batch in batches:
            keys, counts = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([counts, batch.column("n").to_numpy()])
            if len(keys) > 1 << 13:
                done = int(np.searchsorted(keys, keys[-1] // SLOTS * SLOTS))
                if done:
                    yield moved(keys[:done], counts[:done])
                    keys, counts = keys[done:], counts[done:]
        if len(keys):
            yield moved(keys, counts)

    return run


def likelihood(matrix: np.ndarray) -> float:
    """What the classes add to the log likelihood of the unit bigrams."""
    return float(_f(matrix).sum() - _f(matrix.sum(1)).sum() - _f(matrix.sum(0)).sum())


def _cluster(bigrams: DataFrame, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Classes of the units, the class bigrams, and (parts, units moved, likelihood) of each round.

    bigrams: (keys, counts) of unit pairs, packed; seed: the seed unit of each unit.
    """
    spark, units = bigrams.sparkSession, len(seed)

    def counted(value: dict, keys) -> DataFrame:
        shared = spark.sparkContext.broadcast(value | {"units": units})
        return bigrams.mapInArrow(_by_pair(shared, keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    own = fit_in_task(counted({"seed": seed}, _seed_pairs), _clustered)[seed].astype(np.uint8)
    more = np.arange(TOP, max(TOP, units - SUFFIXES - 1))
    own[more] = more % (CLASSES - 1)
    tried, moves, turns, turn, history, reached, matrix = own, 0, TURNS, 0, [], [], None
    while True:
        # one pass a round: the class bigrams of the tried classes, and the contexts of the units to move next
        counts = cut(counted({"own": tried, "turns": turns, "turn": turn}, _round))
        found = counts.where("key < 0").toArrow()
        then = np.bincount(-1 - found["key"].to_numpy(), found["n"].to_numpy().astype(float), CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        history.append((turns, moves, likelihood(then)))
        lowered = matrix is not None and likelihood(then) < reached[-1]
        if not lowered:
            own, matrix = tried, then
        reached.append(likelihood(matrix))
        if len(reached) > TURNS and reached[-1] - reached[-1 - TURNS] <= RISE * abs(reached[-1]):
            break
        if lowered:
            tried, turns, turn = own, turns * 2, 0
            continue
        shared = spark.sparkContext.broadcast({"own": own, "matrix": matrix})
        context = counts.where("key >= 0").repartition(F.expr(f"key div {SLOTS}")).sortWithinPartitions("key")
        moved = context.mapInArrow(_moves(shared), "unit long, class int").toArrow()
        moves = moved.num_rows
        if not moves:
            break
        tried = own.copy()
        tried[moved["unit"].to_numpy()] = moved["class"].to_numpy()
        turn = (turn + 1) % turns
    return own, matrix, history


def exchange(pairs: np.ndarray, n: np.ndarray, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: units move, most frequent first, to the class that raises the bigram likelihood most.

    The last unit (the end) is a class of its own, the last.
    """
    a, b = pairs // units, pairs % units
    end = units - 1
    mass = np.bincount(a, n, units) + np.bincount(b, n, units)
    order = [u for u in np.argsort(-mass, kind="stable") if u != end and mass[u] > 0]
    own = np.zeros(units, np.int64)
    own[order] = np.arange(len(order)) % (classes - 1)
    own[end] = classes - 1
    matrix = np.bincount(own[a] * classes + own[b], n, classes * classes).reshape(classes, classes)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[by_a], np.arange(units + 1)), np.searchsorted(b[by_b], np.arange(units + 1))
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for u in order:
            right, left = by_a[at_a[u] : at_a[u + 1]], by_b[at_b[u] : at_b[u + 1]]
            loop = n[right][b[right] == u].sum()
            after = np.bincount(own[b[right]], np.where(b[right] == u, 0, n[right]), classes)
            before = np.bincount(own[a[left]], np.where(a[left] == u, 0, n[left]), classes)
            old = own[u]
            matrix[old] -= after
            matrix[:, old] -= before
            matrix[old, old] -= loop
            rows, cols, diagonal = matrix.sum(1), matrix.sum(0), np.diag(matrix)
            gain = (f(matrix + after[None, :]) - f(matrix)).sum(1) + (f(matrix + before[:, None]) - f(matrix)).sum(0)
            gain += f(diagonal + after + before + loop) - f(diagonal + after) - f(diagonal + before) + f(diagonal)
            gain -= f(rows + after.sum() + loop) - f(rows) + f(cols + before.sum() + loop) - f(cols)
            best = int(gain[: classes - 1].argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = old
            moved += best != old
            own[u] = best
            matrix[best] += after
            matrix[:, best] += before
            matrix[best, best] += loop
        if not moved:
            break
    return own


def _clustered(table: pa.Table) -> np.ndarray:
    """Classes of the seed units, of their bigrams (key, n)."""
    pair, n = table["key"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(float)
    order = np.argsort(pair)
    return exchange(pair[order], n[order], TOP + SUFFIXES + 1)


def _by_document(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists of each document's distinct hashes and of how often it has them."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(first, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(first, pa.array(np.diff(np.append(at, len(h)))))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in K.slices(batches):
            words = K.Words(batch.column("text"))
            unit, known, at = _units(m, words)
            before, now, token_first = _sequences(m["class"][unit], words.first, CLASSES - 1)
            model = K.sums(m["transition"][before, now] - m["size"][now], token_first)
            logs = np.where(known, m["log"][at] if len(m["log"]) else 0.0, 0.0)
            head = K.sums(logs, words.first) + m["end_log"]
            found = K.sums(known, words.first) + int(m["end_count"] > 0)
            tail, times = _by_document(words.hashes(fold_case=True)[~known], words.doc()[~known], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(words.counts() + 1), pa.array(found), pa.array(head), pa.array(model), tail, times],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_head", "head", "model", "tail", "times"],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the words with A-Z lower-cased and one end. A null text is an empty one:
    its only token is the end. Rows in the held-out fold teach nothing; with none to
    learn from, every count is 0. Repeated rows and doc_ids count each. Columns besides
    doc_id and text are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs).withColumn("held_out", fold(F.col("doc_id"), PARTS) == HELD)
    training = docs.where(~F.col("held_out")).select("text")
    vocabulary = cut(training.mapInArrow(_vocabulary, "w long, s int, c long").groupBy("w").agg(F.min("s").alias("s"), F.sum("c").alias("c")))
    ends = training.count()
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    steps = sorted(((r.step, r.words) for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = max(FREQUENT, SHARE * total)
    least, have = None, 0
    for k, n in steps:
        if have + n > HEAD and 2 ** ((k + 1) / 64) <= frequent:
            break
        least, have = k, have + n
    head = vocabulary.where(step >= least).toPandas() if least is not None else vocabulary.limit(0).toPandas()
    head = head.sort_values(["c", "w"], ascending=[False, True], ignore_index=True)
    own_units = max(min(TOP, len(head)), int((head["c"] >= frequent).sum()))
    head["unit"] = np.where(np.arange(len(head)) < own_units, np.arange(len(head)), -1)
    top = head[: own_units]
    ends_in, size_of = top["s"].to_numpy(np.int64), top["c"].to_numpy(float)
    bucket_counts, bucket_kinds = -np.bincount(ends_in, size_of, SUFFIXES), -np.bincount(ends_in, minlength=SUFFIXES).astype(float)
    for r in vocabulary.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        bucket_counts[r.s] += r.c
        bucket_kinds[r.s] += r.v
    sized = head.assign(key=head["w"].to_numpy(np.int64).view(K.U64)).sort_values("key")
    model = {"words": own_units, "w": sized["key"].to_numpy(K.U64), "unit": sized["unit"].to_numpy(np.int64), "log": np.log10(sized["c"].to_numpy(float) + 0.5)}
    rank = np.arange(own_units)
    seed = np.concatenate([np.where(rank < TOP, rank, TOP + ends_in), TOP + np.arange(SUFFIXES + 1)])

    shared = spark.sparkContext.broadcast(model)
    bigrams = cut(training.mapInArrow(_bigrams(shared), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(_packed, "keys binary, counts binary"))
    own, matrix, _ = _cluster(bigrams, seed)
    unigram = (matrix.sum(0) + 0.5) / (matrix.sum() + 0.5 * CLASSES)
    transition = np.log10((matrix + PRIOR * unigram[None, :]) / (matrix.sum(1, keepdims=True) + PRIOR))
    counts = np.bincount(own[:-1], np.concatenate([size_of, bucket_counts]), CLASSES)
    kinds = np.bincount(own[:-1], np.concatenate([np.ones(own_units), bucket_kinds]), CLASSES)
    counts[-1], kinds[-1] = ends, int(ends > 0)
    model |= {"class": own, "transition": transition, "size": np.log10(counts + 0.5 * (kinds + 1)), "end_log": float(np.log10(ends + 0.5)), "end_count": ends}
    shared = spark.sparkContext.broadcast(model)

    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(_scores(shared), "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, head double, model double, tail array<long>, times array<long>"))
    rare = rows.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("w"), F.col("x.times").alias("m"))
    below = vocabulary.where(step < least) if least is not None else vocabulary
    looked = rare.join(below.select("w", "c"), "w", "left").groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m"))).alias("found"), F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    n_tokens, tokens = F.col("n_tokens"), float(np.log10(total + ends + 0.5 * (distinct + int(ends > 0) + 1)))
    logs = F.col("head") + F.coalesce("logs", F.lit(0.0))
    return rows.drop("tail", "times").join(looked, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(total + ends)).cast("long").alias("train_tokens"), (logs - n_tokens * tokens).alias("base_score"), (logs + F.col("model")).alias("score")
    )
