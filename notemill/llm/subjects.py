"""Problem 6: subject area of each document.

Sentences are represented by averaged word and subword embeddings with one independent logistic
output per subject.  Each round the partitions compute gradients over their training sentences for
the rows of the table that these touch, the executors add them up by ranges of rows, the driver takes
one step, and the new weights are broadcast.  Every sentence of every document is then scored; a
document has a subject if enough of its sentences do.

Besides right labels, noisy hints (predicted domains) give training documents: naive Bayes over
the domains, fitted on the labelled ones, names the subject where it is sure.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.markup import running_text
from notemill.llm.sentences import language_of
from notemill.llm.sentences import sentences as split
from notemill.llm.splits import notebook_key
from notemill.operators.current import current_rows
from notemill.operators.spread import spread
from notemill.session import materialize, release

BUCKETS, WIDTH, SCALE = 1 << 15, 16, 10.0
MAX_NOTEBOOKS = 4000  # bound of each sample: labelled notebooks, and hinted ones
CANDIDATES = 12_000  # unlabelled notebooks among which hinted ones are looked for
MAX_SPELLINGS = 500_000  # names of sampled notebooks up to which they are broadcast, else shuffled
MAX_DOMAINS, MAX_SUBJECTS = 10_000, 10_000  # more are refused
RANGES = 8  # parts of the table in which gradients are added up
ROUNDS = 30
MARGIN = 0.1  # mean log-likelihood ratio of a domain from which a hint counts as sure
HINT_MASS = 0.5
CUT, SHARE = 0.5, 0.2
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


_SIGNS = re.compile(r"[぀-ヿ㐀-鿿]{6}")


def prose(narrative: str) -> list[str]:
    """The sentences of a narrative: those of its paragraphs, and of quotes and list items what has four
    words or more (six signs where there are no blanks); headings, tables and code hold none."""
    out = []
    lang = language_of(narrative, None)
    for kind, text in running_text(narrative):
        for a, b in split(text, lang):
            words = text[a:b].split()
            if len(words) >= 4 or (_SIGNS.search(text, a, b) if words and not text.isascii() else kind == "paragraph" and len(words) > 1 and text[b - 1] in ".!?"):
                out.append(" ".join(words))
    return out


@lru_cache(1 << 17)
def unit_ids(unit: str) -> list[int]:
    """Hashed ids of a unit: a word with its subwords (3 to 5 signs of the framed word), or a pair of words."""
    if " " in unit:
        return [zlib.crc32(f"b:{unit}".encode()) % BUCKETS]
    framed = f"<{unit}>"
    pieces = [f"w:{unit}"] + [framed[k : k + n] for n in (3, 4, 5) for k in range(len(framed) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in pieces]


def sentence_units(sentence: str) -> list[str]:
    """The words of a sentence and its pairs of neighbouring words."""
    words = _WORD.findall(sentence.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _sum_runs(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, run after run; an empty run gives zeros."""
    out = np.zeros((len(starts), rows.shape[1]), np.float32)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(rows, starts[some], axis=0)
    return out


class Runs:
    """Groups of members: ``gather`` sums the rows of each group's members, ``scatter`` gives each
    member the sum of the rows of its groups.  Both go along runs, so nothing is added at random;
    ``groups``, the groups in the order of their members, can be kept to save sorting again."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, n: int, groups: np.ndarray | None = None) -> None:
        self.members, self.sizes, self.n, self._groups = members, sizes, n, groups
        self.starts = np.cumsum(sizes) - sizes

    @property
    def groups(self) -> np.ndarray:
        if self._groups is None:
            self._groups = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[np.argsort(self.members, kind="stable")]
        return self._groups

    def gather(self, rows: np.ndarray) -> np.ndarray:
        return _sum_runs(rows[self.members], self.starts, self.sizes)

    def scatter(self, rows: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.members, minlength=self.n)
        return _sum_runs(rows[self.groups], np.cumsum(counts) - counts, counts)


class Block:
    """Sentences as sums of distinct units, and units as sums of hashed embeddings.

    Each unit's vector is computed once however often it occurs, which leaves the average over
    all ids of a sentence exactly what it is.  Only the rows of the table that the block touches
    are used, ``touched`` by number.
    """

    def __init__(self, touched: np.ndarray, of_unit: Runs, of_sentence: Runs) -> None:
        self.touched, self.of_unit, self.of_sentence = touched, of_unit, of_sentence
        self.n = len(of_sentence.sizes)
        total = of_sentence.gather(of_unit.sizes[:, None].astype(np.float32))[:, 0] if self.n else np.zeros(0, np.float32)
        self.scale = (SCALE / np.maximum(total, 1))[:, None].astype(np.float32)

    @classmethod
    def of(cls, sentences: list[str]) -> Block:
        index: dict[str, int] = {}
        members, lengths = [], []
        for s in sentences:
            own = [index.setdefault(u, len(index)) for u in sentence_units(s)]
            members += own
            lengths.append(len(own))
        ids = [unit_ids(u) for u in index]
        touched, own = np.unique(np.array([i for x in ids for i in x], np.int32), return_inverse=True)
        of_unit = Runs(own.astype(np.int32), np.array([len(x) for x in ids], np.int32), len(touched))
        return cls(touched, of_unit, Runs(np.array(members, np.int32), np.array(lengths, np.int32), len(ids)))

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(x, np.int32).tobytes() for x in (self.touched, *[y for r in (self.of_unit, self.of_sentence) for y in (r.members, r.sizes, r.groups)])]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Block:
        touched, ids, sizes, units, members, lengths, own = (np.frombuffer(x, np.int32) for x in packed)
        return cls(touched, Runs(ids, sizes, len(touched), units), Runs(members, lengths, len(sizes), own))

    def hidden(self, table: np.ndarray) -> np.ndarray:
        return self.of_sentence.gather(self.of_unit.gather(table[self.touched])) * self.scale

    def table_gradient(self, back: np.ndarray) -> np.ndarray:
        """Gradient of the rows ``touched``."""
        return self.of_unit.scatter(self.of_sentence.scatter((back * self.scale).astype(np.float32)))


class SubjectModel:
    """Embeddings, output weights and biases; gradient of the logistic loss and Adam steps."""

    def __init__(self, subjects: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.subjects = subjects
        k = len(subjects)
        self.weights = [rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, k)).astype(np.float32), np.full(k, -2.0, np.float32)]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    @staticmethod
    def scores(weights: list[np.ndarray], block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-(block.hidden(weights[0]) @ weights[1] + weights[2])))

    @staticmethod
    def gradient(weights: list[np.ndarray], block: Block, targets: np.ndarray, masses: np.ndarray, refined: bool = False) -> tuple[list[np.ndarray], float]:
        """Gradient (table rows that the block touches, output weights, biases) and mass.

        A sentence may stand for many equal ones: ``masses`` (number, sum of masses) and ``targets``
        (sum of targets, sum of mass x target) are sums over them, of which the gradient is linear.
        """
        hidden = block.hidden(weights[0])
        guess = 1 / (1 + np.exp(-(hidden @ weights[1] + weights[2])))
        if refined:
            sure = guess.max(axis=1, initial=0) > 0.6
            # a sentence that the model takes for no subject is talk about data work or a passing mention
            mass, target = masses[:, :1], np.where(sure[:, None], (guess > 0.6) * masses[:, :1], targets[:, 0] * 0.3)
        else:
            mass, target = masses[:, 1:], targets[:, 1]
        error = (guess * mass - target).astype(np.float32)
        return [block.table_gradient(error @ weights[1].T), hidden.T @ error, error.sum(axis=0)], float(mass.sum())

    def step(self, gradient: list[np.ndarray], mass: float, rate: float = 0.05) -> None:
        self.steps += 1
        for k, (w, g) in enumerate(zip(self.weights, gradient, strict=True)):
            g = g / mass + (1e-7 * w if k == 0 else 0)
            m, v = self.moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)


def sentence_table(nb_contents: DataFrame) -> DataFrame:
    """(notebook_id, sentences) of the current narratives: their prose sentences in order."""
    current = current_rows(nb_contents, ["notebook_id"], "scraped_at", ["markdown_narrative"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([prose(t) for t in batch.column("markdown_narrative").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("notebook_id"), found], names=["notebook_id", "sentences"])

    return spread(current.where("markdown_narrative is not null")).mapInArrow(run, "notebook_id long, sentences array<string>")


SENTENCES_A_ROW = 50_000
PACKED = "block array<binary>, targets binary, masses binary"


def pack_training(index: dict[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training sentences (sentence, subjects, mass) as arrays, a row for at most ``SENTENCES_A_ROW``
    different ones; equal ones are added up."""
    number: dict[str, int] = {}
    sums: list[np.ndarray] = []

    def row() -> pd.DataFrame:
        packed = np.array(sums, np.float32).reshape(len(sums), -1)
        out = pd.DataFrame([(Block.of(list(number)).pack(), packed[:, 2:].tobytes(), packed[:, :2].tobytes())], columns=["block", "targets", "masses"])
        number.clear()
        sums.clear()
        return out

    for batch in batches:
        for sentence, names, mass in zip(batch["sentence"], batch["subjects"], batch["mass"], strict=True):
            label = np.zeros(len(index), np.float32)
            label[[index[s] for s in names]] = 1.0 / len(names)
            own = np.concatenate([[1.0, mass], label, mass * label])
            if sentence in number:
                sums[number[sentence]] += own
            else:
                if len(number) >= SENTENCES_A_ROW:
                    yield row()
                number[sentence] = len(number)
                sums.append(own)
    if number:
        yield row()


def unpack(row: object) -> tuple[Block, np.ndarray, np.ndarray]:
    """(block, targets, masses) of a packed row."""
    block = Block.unpack(list(row.block))
    return block, np.frombuffer(row.targets, np.float32).reshape(block.n, 2, -1), np.frombuffer(row.masses, np.float32).reshape(block.n, 2)


def subject_hints(nb_contents: DataFrame, predictions: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(notebook_id, subjects): the subject of unlabelled notebooks that their predicted domains are sure of.

    ``predictions`` (notebook, top_domains) name notebooks in any spelling.  Hints are looked for
    among about ``CANDIDATES`` unlabelled notebooks, chosen by a hash of their ids.  The table of
    domains by subject comes to the driver; more than ``MAX_DOMAINS`` domains are refused.
    """
    ids = nb_contents.select("notebook_id", notebook_key(F.col("notebook")).alias("slug")).where("notebook_id is not null and slug is not null").distinct()
    single = labels.where(F.col("subject").isin(subjects)).groupBy("notebook_id").agg(F.collect_set("subject").alias("s"))
    fitted = _sample(single.where("size(s) = 1"), 23).join(ids, "notebook_id").select("slug", F.col("s")[0].alias("subject"))
    asked = _sample(ids.join(single, "notebook_id", "left_anti"), 24, CANDIDATES).select("slug").distinct()
    # spellings are few compared with predictions, and only those of chosen notebooks are read on
    chosen = fitted.unionByName(asked.withColumn("subject", F.lit(None).cast("string")))
    spellings = predictions.select("notebook").where("notebook is not null").distinct().withColumn("slug", notebook_key(F.col("notebook")))
    wanted = materialize(spellings.join(F.broadcast(chosen), "slug"), n=F.count(F.lit(1)))
    if wanted.counts["n"] <= MAX_SPELLINGS:
        wanted = F.broadcast(wanted)
    listed = predictions.select("notebook", "top_domains").join(wanted, "notebook").select("slug", "subject", F.explode("top_domains").alias("domain"))
    named = materialize(listed.select("slug", "subject", F.lower(F.trim("domain")).alias("domain")).where("domain is not null").groupBy("slug", "subject", "domain").agg(F.count("*").alias("n")))
    known = named.where("subject is not null").groupBy("subject", "domain").agg(F.sum("n").alias("n"))
    seen: dict[str, dict[str, int]] = {}
    rows = known.limit(MAX_DOMAINS * max(1, len(subjects)) + 1).collect()
    for r in rows:
        seen.setdefault(r["domain"], {})[r["subject"]] = r["n"]
    if len(seen) > MAX_DOMAINS or len(rows) > MAX_DOMAINS * max(1, len(subjects)):
        raise ValueError(f"more than {MAX_DOMAINS} distinct domains among the labelled notebooks")
    spark = nb_contents.sparkSession
    total = {s: sum(d.get(s, 0) for d in seen.values()) for s in subjects}
    rows = []
    for domain, by in sorted(seen.items()):
        logs = [math.log((by.get(s, 0) + 0.5) / (total[s] + 0.5 * len(seen))) for s in subjects]
        mean = sum(logs) / len(logs)
        rows.append((domain, *[x - mean for x in logs]))
    columns = [f"l{k}" for k in range(len(subjects))]
    table = F.broadcast(spark.createDataFrame(rows, ", ".join(["domain string", *[f"{c} double" for c in columns]])))
    sums = named.where("subject is null").join(table, "domain").groupBy("slug").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in columns])
    order = F.sort_array(F.array(*[F.struct((F.col(c) / F.col("n")).alias("mean"), F.lit(k).alias("k")) for k, c in enumerate(columns)]), asc=False) if columns else F.array().cast("array<struct<mean double, k int>>")
    ranked = sums.withColumn("top", order)
    names = F.array(*[F.lit(s) for s in subjects]) if subjects else F.array().cast("array<string>")
    sure = ranked.where(f"size(top) = 1 or size(top) > 1 and top[0].mean - top[1].mean >= {MARGIN}").select("slug", F.array(names[F.col("top")[0]["k"]]).alias("subjects"))
    return sure.join(ids, "slug").join(single, "notebook_id", "left_anti").select("notebook_id", "subjects")


def _sample(sets: DataFrame, seed: int, most: int = MAX_NOTEBOOKS) -> DataFrame:
    """About ``most`` rows of ``sets`` by a hash of their ids; all if there are no more."""
    total = sets.agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "notebook_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return sets.crossJoin(F.broadcast(total)).where(F.col("_n") * draw < most).drop("_n")


def train(sentences: DataFrame, labels: DataFrame, hints: DataFrame, subjects: list[str], rounds: int = ROUNDS) -> SubjectModel:
    """Fit the model on the sentences of a bounded sample of labelled and of hinted notebooks.

    A notebook's labels hold for its sentences as a whole, so sentences of notebooks with one
    label are positives of that label.  Sentences on data work occur under all labels alike and
    end up with none.  In the last rounds the model itself says which sentences are positive.
    """
    spark = sentences.sparkSession
    index = {s: k for k, s in enumerate(subjects)}
    sets = labels.where("notebook_id is not null").where(F.col("subject").isin(subjects)).groupBy("notebook_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = _sample(sets, 21).withColumn("mass", F.when(F.size("subjects") == 1, 1.0).otherwise(0.3)).unionByName(_sample(hints, 22).withColumn("mass", F.lit(HINT_MASS)))
    # equal sentences come together and are added up; as many parts as there are cores
    tasks = max(2, spark.sparkContext.defaultParallelism)
    dealt = sentences.join(F.broadcast(chosen), "notebook_id").select(F.explode("sentences").alias("sentence"), "subjects", "mass").repartition(tasks, "sentence")
    rows = materialize(dealt.mapInPandas(lambda batches: pack_training(index, batches), PACKED))
    model = SubjectModel(subjects)
    width = BUCKETS // RANGES
    schema = "part int, ids binary, rows binary"

    def gradients(weights, refined: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, rest = None, None
            for batch in batches:
                for row in batch.itertuples():
                    block, targets, masses = unpack(row)
                    (own, *outer), mass = SubjectModel.gradient(weights.value, block, targets, masses, refined)
                    outer = np.concatenate([*[g.ravel() for g in outer], [mass]])
                    if table is None:
                        table, rest = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(len(outer))
                    table[block.touched] += own
                    rest += outer
            if table is not None:
                touched = np.flatnonzero(table.any(axis=1)).astype(np.int32)
                parts = [touched[(touched >= r * width) & (touched < (r + 1) * width)] for r in range(RANGES)]
                yield pd.DataFrame([(r, own.tobytes(), table[own].tobytes()) for r, own in enumerate(parts)] + [(RANGES, b"", rest.tobytes())], columns=["part", "ids", "rows"])

        return run

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] == RANGES:
            return pd.DataFrame({"part": [RANGES], "ids": [b""], "rows": [sum(np.frombuffer(x) for x in group["rows"]).tobytes()]})
        table = np.zeros((width, WIDTH), np.float32)
        for ids, own in zip(group["ids"], group["rows"], strict=True):
            table[np.frombuffer(ids, np.int32) - key[0] * width] += np.frombuffer(own, np.float32).reshape(-1, WIDTH)
        return pd.DataFrame({"part": [key[0]], "ids": [b""], "rows": [table.tobytes()]})

    for number in range(rounds):
        weights = spark.sparkContext.broadcast(model.weights)
        sums = rows.mapInPandas(gradients(weights, number >= rounds * 0.6), schema).groupBy("part").applyInPandas(added, schema)
        got = {r["part"]: r["rows"] for r in sums.toArrow().to_pylist()}
        weights.unpersist()
        if not got:
            break
        table = np.concatenate([np.frombuffer(got[r], np.float32).reshape(width, WIDTH) for r in range(RANGES)])
        rest, k = np.frombuffer(got[RANGES]), WIDTH * len(subjects)
        model.step([table, rest[:k].reshape(WIDTH, -1).astype(np.float32), rest[k:-1].astype(np.float32)], rest[-1])
    release(rows)
    return model


def score_notebooks(sentences: DataFrame, model: SubjectModel, cut: float) -> DataFrame:
    """(notebook_id, k, n_sentences, n_with): sentences of each notebook that have subject k."""
    weights = sentences.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sentences")
            coded = lists.flatten().dictionary_encode()
            parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            has = SubjectModel.scores(weights.value, Block.of(coded.dictionary.to_pylist())) >= cut
            own = has[coded.indices.to_numpy(zero_copy_only=False)]
            # sentences of a notebook stand together
            n_with = _sum_runs(own.astype(np.float32), np.searchsorted(parents, np.arange(len(lists))), np.bincount(parents, minlength=len(lists)))
            row, k = np.nonzero(n_with)
            columns = [batch.column("notebook_id").take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(np.bincount(parents, minlength=len(lists))[row].astype(np.int64)), pa.array(n_with[row, k].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["notebook_id", "k", "n_sentences", "n_with"])

    return sentences.mapInArrow(run, "notebook_id long, k int, n_sentences long, n_with long")


def subject_shares(nb_contents: DataFrame, predictions: DataFrame, labels: DataFrame, subjects: DataFrame, cut: float = CUT) -> DataFrame:
    """Share of sentences by subject as (notebook_id, subject, n_sentences, n_with, share), shares above 0.

    ``subjects`` (subject, description) is the fixed list of names, ``labels`` (notebook_id,
    subject) are right, ``predictions`` (notebook, top_domains) are hints.  Null and empty narratives
    have no sentence and no row; unlabelled notebooks are scored like all others; labels that
    ``subjects`` lacks are ignored; repeated labels count once.  An empty label table gives a
    model without subjects and no rows.
    """
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    sentences = materialize(sentence_table(nb_contents))
    hints = materialize(subject_hints(nb_contents, predictions, labels, names))
    model = train(sentences, labels, hints, names)
    table = sentences.sparkSession.createDataFrame(list(enumerate(names)), "k int, subject string")
    found = score_notebooks(spread(sentences), model, cut)
    return found.join(F.broadcast(table), "k").select("notebook_id", "subject", "n_sentences", "n_with", (F.col("n_with") / F.col("n_sentences")).alias("share"))
