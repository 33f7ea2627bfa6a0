"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters are lower-cased, everything else is a word bound; a model of order n predicts every letter of a word,
and its end, from the n - 1 symbols before, which reach back to the beginning of the word. All labelled rows are
counted, whatever their size. Spark counts what every order needs from all n-grams of the
highest one: how many symbols come before an n-gram, what a context adds up to, and a discount for each order. A
model then lists the n-grams that make up a fixed share of a language's symbols or more, at every size of table
alike; what the others of a context are due goes to its back-off weight, so probabilities still add up to 1. An n-gram's probabilities in all languages lie in one row of a table
whose 64-bit keys are sorted and indexed by their leading bits; n-grams not in it back off order by order.

A text gets the language of the lowest cross-entropy a symbol. The score is the share of that language among
all, at a temperature fitted on all labelled texts, each judged by models of the half of the rows that it is not in. A
text is rejected when its cross-entropy is nearer to what such models give to texts of other languages than to their
own; short texts get room for chance.

Null texts and texts without a letter are ``und``, with score 0, and rejected. Equal entropies go to the
language first in order. Without labelled rows everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.llm.staging import is_empty, stage
from volfuse.llm.texts import U64, filtered, mix, per_text, pieces, ragged, share, text_bytes

ORDER = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)
UNKNOWN = "und"
#: Labels before the languages while models of all rows and of either half are learned side by side.
ALL, HALVES = "*", ("0", "1")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case form of every letter's code point, 0 for all others."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, 0 for the end of a word, the bounds of each text, and each symbol's age in its word."""
    raw, at = text_bytes(column)
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    codes = letters()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    bounds = np.searchsorted(place, at)
    # Every text ends with a bound, so that its last word does.
    codes = np.insert(codes, bounds[1:], 0)
    bounds = bounds + np.arange(len(bounds))
    kept = codes > 0
    kept[1:] |= codes[:-1] > 0
    age = np.arange(len(codes))
    begins = np.ones(len(codes), bool)
    begins[1:] = codes[:-1] == 0
    age -= np.maximum.accumulate(np.where(begins, age, 0))
    return codes[kept], per_bounds(kept, bounds), age[kept]


def per_bounds(kept: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(per_text(kept, at))])


def history(codes: np.ndarray, age: np.ndarray, order: int) -> list[np.ndarray]:
    """The symbol itself and the ones before it, 0 beyond the beginning of its word."""
    out = [codes]
    for j in range(1, order):
        back = np.zeros(len(codes), codes.dtype)
        back[j:] = codes[:-j]
        back[age < j] = 0
        out.append(back)
    return out


def key(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(parts[0]), len(parts), U64)
    for j, part in enumerate(parts):
        total += (part.astype(U64) + U64(1)) * _ODD[j]
    return mix(total)


class Table(NamedTuple):
    """Rows by sorted 64-bit key; ``first`` has where the keys with given leading bits begin."""

    keys: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    bits: int

    @staticmethod
    def of(keys: np.ndarray, rows: np.ndarray) -> Table:
        bits = max(1, int(len(keys)).bit_length())
        return Table(keys, rows, np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)), bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key, -1 if there is none."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        part = (keys >> U64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[part], self.first[part + 1]
        rows = np.flatnonzero(at < stop)
        while len(rows):
            hit = self.keys[at[rows]] == keys[rows]
            out[rows[hit]] = at[rows[hit]]
            rows = rows[~hit]
            at[rows] += 1
            rows = rows[at[rows] < stop[rows]]
        return out


class Model(NamedTuple):
    languages: list[str]
    grams: list[Table]  # by order, from 1: natural logarithms of the probabilities, a column per language
    contexts: list[Table]  # by order: logarithms of the back-off weights
    floor: np.ndarray  # of a symbol never met
    temperature: float = 1.0
    limits: np.ndarray | None = None
    spread: np.ndarray | None = None  # by language: how far chance carries the entropy of a text, times the root of its symbols

    def log_probability(self, parts: list[np.ndarray]) -> np.ndarray:
        """For each symbol and language."""
        n = len(parts)
        row = self.grams[n - 1].find(key(parts))
        out = self.grams[n - 1].rows[row] if len(self.grams[n - 1].rows) else np.zeros((len(row), len(self.languages)), np.float32)
        rest = np.flatnonzero(row < 0)
        if len(rest):
            shorter = [p[rest] for p in parts]
            out[rest] = self.floor if n == 1 else self.backed(shorter)
        return out

    def backed(self, parts: list[np.ndarray]) -> np.ndarray:
        n = len(parts)
        weight = self.contexts[n - 1]
        row = weight.find(key(parts[1:]))
        out = self.log_probability(parts[:-1])
        known = row >= 0
        out[known] += weight.rows[row[known]]
        return out

    def entropies(self, column: pa.Array, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text in each language, and the number of symbols; ``step`` symbols at once.

        A symbol depends on its word alone, so every different word is looked up once."""
        codes, at, age = symbols(column)
        n = np.diff(at)
        start = np.flatnonzero(age == 0)
        if not len(start):
            return np.zeros((len(n), len(self.languages))), n
        size = np.diff(np.append(start, len(codes)))
        _, one, same = np.unique(np.add.reduceat(key([codes, age]), start), return_index=True, return_inverse=True)
        take, word = ragged(start[one], size[one]), np.repeat(np.arange(len(one)), size[one])
        codes, age = codes[take], age[take]
        words = np.zeros((len(one), len(self.languages)))
        for a in range(0, len(codes), step):
            back = max(0, a - ORDER + 1)
            parts = [p[a - back :] for p in history(codes[back : a + step], age[back : a + step], ORDER)]
            log_p = self.log_probability(parts)
            for k in range(len(self.languages)):
                words[:, k] += np.bincount(word[a : a + step], log_p[:, k], len(one))
        owner = np.searchsorted(at, start, "right") - 1
        total = np.column_stack([np.bincount(owner, w[same], len(n)) for w in words.T]) if self.languages else np.zeros((len(n), 0))
        return -total / np.maximum(1, n)[:, None], n

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is accepted, and the cross-entropy."""
        h, n = self.entropies(column)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        share_ = 1 / np.exp(np.clip((low[:, None] - h) * np.sqrt(n)[:, None] * self.temperature, -700, 0)).sum(axis=1)
        some = n > 0
        accepted = some & (low <= self.limits[best] + self.spread[best] / np.sqrt(np.maximum(1, n)))
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, share_, 0.0), accepted, low


def _added(keys: np.ndarray, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    own, first, same = np.unique(keys, return_index=True, return_inverse=True)
    return own, rows[first], np.bincount(same, count, len(own)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Counts of the highest order's n-grams by language, added up in memory as long as ``most`` kinds hold them."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        _, gram, count = held[0]
        columns = [pa.array(np.array(list(names), object)[gram[:, 0]], pa.string()), *(pa.array(gram[:, j + 1], pa.int32()) for j in range(ORDER)), pa.array(count)]
        return pa.record_batch(columns, ["lang", *(f"c{j}" for j in range(ORDER)), "n"])

    for batch in batches:
        for part in pieces(batch):
            codes, at, age = symbols(part.column("text"))
            if not len(codes):
                continue
            lang = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()])
            # Every different word is cut into n-grams once.
            start = np.flatnonzero(age == 0)
            own = lang[np.searchsorted(at, start, "right") - 1]
            size = np.diff(np.append(start, len(codes)))
            hashes = np.add.reduceat(key([codes, age]), start)
            _, one, times = np.unique(key([own, hashes]), return_index=True, return_counts=True)
            take, size = ragged(start[one], size[one]), size[one]
            table = [np.repeat(own[one], size), *history(codes[take], age[take], ORDER)]
            held.append(_added(key(table), np.column_stack(table).astype(np.int32), np.repeat(times, size)))
            if sum(len(x[0]) for x in held[1:]) > most:
                held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > most:
                    yield rows()
                    held = []
    if held:
        held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
        yield rows()


def kneser_ney(languages: list[str], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], alphabet: int) -> Model:
    """Models from what is listed of each order, from 1: the language, the n-gram (the symbol first, then the ones before
    it) and its discounted share of its context. What a context's shares leave of 1 is the weight of the next lower order,
    and in the end of any of the ``alphabet`` symbols."""
    some = len(languages)
    model = Model(languages, [], [], np.zeros(some, np.float32))
    for n, (own, now, value) in enumerate(levels, 1):
        gram_of, gram_row = np.unique(now, axis=0, return_inverse=True)
        part = np.zeros((len(gram_of), some))
        part[gram_row.ravel(), own] = value
        ctx, ctx_row = np.unique(gram_of[:, 1:], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0)), np.zeros(len(gram_of), int))
        ctx_row = ctx_row.ravel()
        taken = np.zeros((len(ctx), some))
        np.add.at(taken, ctx_row, part)
        weight = np.maximum(1 - taken, 1e-12)
        if n == 1:
            model = model._replace(floor=np.log(weight[0] / alphabet).astype(np.float32))
            lower = np.full((len(gram_of), some), 1 / alphabet)
        else:
            lower = np.exp(model.log_probability([gram_of[:, j] for j in range(n - 1)]).astype(float))
        log_p = np.log(part + weight[ctx_row] * lower).astype(np.float32)
        keys = key([gram_of[:, j] for j in range(n)])
        by = np.argsort(keys)
        model.grams.append(Table.of(keys[by], log_p[by]))
        if n > 1:
            keys = key([ctx[:, j] for j in range(n - 1)])
            by = np.argsort(keys)
            model.contexts.append(Table.of(keys[by], np.log(weight[by]).astype(np.float32)))
        else:
            model.contexts.append(Table.of(np.zeros(0, U64), np.zeros((0, some), np.float32)))
    return model


def _per_language(values: dict[str, float]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("lang")]


def learned(counts: DataFrame, rare: float) -> Model:
    """The models of all counted n-grams of the highest order: lang, c0 (the symbol) and those before it, n.

    Every order's counts are those of all n-grams, none left out. Listed are the n-grams that occur ``rare`` times the
    symbols of their language or more, so 1 / ``rare`` of a language and order at most. A context has no more n-grams
    than there are letters, whatever the table, so its sum is a small window.
    """
    names = [f"c{j}" for j in range(ORDER)]
    level = counts.select("lang", *names, F.col("n").alias("value"), F.col("n").alias("tokens"))
    tables = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # of the shorter n-gram count the different symbols that come before it
            level = stage(level.groupBy("lang", *names[:n]).agg(F.count("*").alias("value"), F.sum("tokens").alias("tokens")), "grams")
        few = [F.count_if(F.col("value") == k) for k in (1, 2)]
        facts = {r[0]: r[1:] for r in level.groupBy("lang").agg(F.sum("tokens"), *few).collect()}
        discount = {k: min(0.9, max(0.1, once / max(1, once + 2 * twice))) for k, (_, once, twice) in facts.items()}
        whole = F.sum("value").over(Window.partitionBy("lang", *names[1:n]))
        shares = level.withColumn("share", (F.col("value") - _per_language(discount)) / whole)
        often = F.col("tokens") >= _per_language({k: rare * v[0] for k, v in facts.items()})
        tables.append(shares.where(often).select("lang", *names[:n], "share").toArrow())
    alphabet = level.select("c0").distinct().count() + 1
    languages = sorted(facts)
    levels = []
    for n, table in enumerate(reversed(tables), 1):
        owner = np.searchsorted(np.array(languages, object), table.column("lang").to_numpy(zero_copy_only=False)) if table.num_rows else np.zeros(0, int)
        grams = np.column_stack([table.column(c).to_numpy() for c in names[:n]]).astype(np.int64)
        levels.append((owner, grams, table.column("share").to_numpy()))
    return kneser_ney(languages, levels, alphabet)


def part(model: Model, label: str) -> Model:
    """Of models whose languages begin with labels those of one label, without it."""
    own = [k for k, name in enumerate(model.languages) if name.startswith(label)]
    cut = lambda tables: [t._replace(rows=np.ascontiguousarray(t.rows[:, own])) for t in tables]
    return Model([model.languages[k][len(label) :] for k in own], cut(model.grams), cut(model.contexts), model.floor[own])


def fit(docs: DataFrame, learn: Column, rare: float = 4e-6) -> Model | None:
    """The models of all rows where ``learn`` holds, calibrated by all of them too: the ids are dealt into two halves, and
    each half's texts are judged by models of the other half, which haven't counted them. ``rare`` is the share of a
    language's symbols from which on an n-gram is listed."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    half = F.when(share(F.col("doc_id"), 8) < 0.5, HALVES[0]).otherwise(HALVES[1])
    known = known.select(half.alias("half"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("text").rlike(r"\p{L}"))
    names = [f"c{j}" for j in range(ORDER)]
    counts = known.select(F.concat("half", "lang").alias("lang"), "text").mapInArrow(_counts, f"lang string, {' int, '.join(names)} int, n bigint")
    added = lambda rows: rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    halves = stage(added(counts), "grams")
    if is_empty(halves):
        return None
    whole = halves.withColumn("lang", F.concat(F.lit(ALL), F.expr("substring(lang, 2)")))
    models = learned(stage(halves.union(added(whole)), "grams"), rare)
    judges = {own: part(models, other) for own, other in (HALVES, HALVES[::-1])}
    return calibrated(part(models, ALL), known, judges)


def calibrated(model: Model, held: DataFrame, judges: dict[str, Model] | None = None, deviations: float = 4.0, enough: int = 20) -> Model:
    """Temperature and limits of rejection from all texts of ``held`` that have 20 symbols or more.

    ``judges`` has the models that judge the texts of each ``half``; without them ``model`` judges all. Short texts get room
    for ``deviations`` standard deviations, told by the median so that odd texts don't count; a language with fewer than
    ``enough`` texts gets the room of all languages. Medians are those of entropies rounded to 0.0001, so what is held for
    them is bounded by the different values, and the driver gets a few numbers for each language.
    """
    if judges is None:
        judges, held = {ALL: model}, held.withColumn("half", F.lit(ALL))
    box, some = held.sparkSession.sparkContext.broadcast(judges), len(model.languages)
    place = {name: k for k, name in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, judge in box.value.items():
                for texts in pieces(batch.filter(pc.equal(batch.column("half"), half))):
                    truth = np.array([place.get(x, -1) for x in texts.column("lang").to_pylist()])
                    h = np.full((len(truth), some), np.inf)  # of a language that the judge hasn't met
                    h[:, [place[x] for x in judge.languages]], n = judge.entropies(texts.column("text"))
                    own = h[np.arange(len(h)), truth]
                    used = (n >= 20) & (truth >= 0) & np.isfinite(own)
                    h, own, truth = h[used], own[used], truth[used]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * some, pa.int32()), pa.array(h.ravel()))
                    # A text that another language fits better may be mislabelled: it says nothing of the limits.
                    columns = [pa.array(truth, pa.int32()), pa.array(own), pa.array(n[used], pa.int64()), pa.array(h.argmin(axis=1) == truth), lists]
                    yield pa.record_batch(columns, ["lang", "own", "n", "sure", "h"])

    judged = held.select("half", "lang", "text").mapInArrow(run, "lang int, own double, n bigint, sure boolean, h array<double>")
    judged = stage(judged, "judged")

    def loss(t: float) -> Column:
        z = lambda x: F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (F.col("own") - x) * F.sqrt("n") * F.lit(t)))
        return F.avg(F.log(F.aggregate("h", F.lit(0.0), lambda total, x: total + F.exp(z(x)))))

    steps = (2.0 ** np.arange(-4, 3, 0.5)).tolist()
    losses = judged.agg(*[loss(t) for t in steps]).first()
    limits, spread = np.full(some, np.inf), np.zeros(some)
    if losses[0] is None:
        return model._replace(limits=limits, spread=spread)
    sure = judged.where("sure")

    def medians(value: Column) -> dict[int | None, tuple[float, int]]:
        """Median and number of texts by language, and of all languages at None."""
        return {r[0]: (r[1], r[2]) for r in sure.rollup("lang").agg(F.median(value), F.count("*")).collect()}

    if usual := medians(F.round("own", 4)):
        middle = [usual.get(k, usual[None])[0] for k in range(some)]
        off = medians(F.round(F.abs(F.col("own") - F.array(*map(F.lit, middle))[F.col("lang")]) * F.sqrt("n"), 3))
        other = sure.select("lang", F.posexplode("h").alias("k", "x")).where("k != lang and x < double('infinity')")
        others = dict(other.groupBy("k").agg(F.median(F.round("x", 4))).collect())
        for k in range(some):
            if k in others:
                limits[k] = (middle[k] + others[k]) / 2
            mine, texts = off.get(k, (0.0, 0))
            spread[k] = deviations * 1.4826 * (mine if texts >= enough else off[None][0])
    return model._replace(temperature=steps[int(np.argmin(losses))], limits=limits, spread=spread)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: id, language, score, whether it is accepted, and the cross-entropy in nats a symbol."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = box.value
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                if fitted is None:
                    names, score, accepted, low = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n)
                else:
                    names, score, accepted, low = fitted.judge(part.column("text"))
                columns = [part.column("doc_id"), pa.array(names, pa.string()), *map(pa.array, (score, accepted, low))]
                yield pa.record_batch(columns, ["doc_id", "lang_pred", "score", "accepted", "entropy"])

    schema = "doc_id bigint, lang_pred string, score double, accepted boolean, entropy double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that ``identify`` accepts, with all their columns; rows without an id or with a shared one are judged
    alike. Without a model nothing is rejected."""
    if model is None:
        return docs
    box = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda column: box.value.judge(column)[2])
