"""Operator 9: toxicity by weak supervision.

* *Voters*: each says "toxic" or "clean" where its pattern stands in a text, and
  abstains elsewhere.  Three kinds: hand-written word lists in several languages
  and of both polarities, hand-written patterns of form (shouting, exclamation
  runs, masked swear words, direct address), and words or word beginnings that
  one half of the labelled sample suggests (a development set; for the invented
  or unlisted vocabulary of a corpus).
* *Label model*: a generative model of the unknown label.  Each voter fires at a
  rate of its own given the label and given one other voter, its parent in a tree
  of the strongest conditional correlations; rates, tree and posteriors are
  estimated together by expectation maximisation.  Given labels take no part
  in it but for the share of toxic texts (the prior).
* *Classifier*: logistic regression on presence and rate of the voters'
  patterns, trained on the label model's posteriors; it scores every text.

The model learns from a bounded sample of the labelled rows, drawn by hash of
doc_id (``sample_rows``); scoring reads every whole text, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import TextChunks, WordHasher, byte_class, crc32_of_id, documents, mix64, staged

SAMPLE_ROWS = 20_000
SUGGESTED = 320
LEAST_SUPPORT = 0.004  # of the toxic training rows
BEGINNINGS = (4, 5, 6, 7, 8, 9)  # bytes
THRESHOLD = 0.3
#: What a labelled development row counts in the prior of the rates, against one unlabelled row.
DEVELOPMENT_WEIGHT = 3.0
#: Words of letters and non-ASCII characters, so that punctuation doesn't matter.
LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))

TOXIC, CLEAN = 1, -1

#: name, polarity, words
LEXICONS = [
    ("en insults to the mind", TOXIC, "idiot idiots moron morons stupid imbecile dumb dumbass dimwit halfwit brainless cretin fool foolish dunce simpleton braindead"),
    ("en insults to worth", TOXIC, "loser losers worthless pathetic useless nobody failure coward weakling spineless wretch lowlife"),
    ("en disgust", TOXIC, "disgusting trash garbage scum filth filthy vile repulsive revolting vermin parasite disgrace sickening"),
    ("en mockery", TOXIC, "clown clowns joke laughable ridiculous crybaby whiner buffoon snowflake"),
    ("en hostility", TOXIC, "hate hateful despise loathe detest kill destroy hurt smash"),
    ("en swearing", TOXIC, "damn crap bastard bastards bitch ass asshole jerk shit bullshit fuck fucking piss"),
    ("en dismissal", TOXIC, "shut begone drown choke vanish"),
    ("fr insults", TOXIC, "idiot idiote imbécile crétin crétine débile stupide abruti abrutie connard connasse minable"),
    ("fr disgust", TOXIC, "ordure ordures dégoûtant dégoûtante pourriture raclure déchet immonde répugnant salaud salope merde"),
    ("fr hostility", TOXIC, "haine déteste crève tuer ferme dégage clown bouffon lâche pathétique"),
    ("de insults", TOXIC, "idiot idioten trottel dummkopf depp blöd blödmann dumm schwachkopf vollidiot versager"),
    ("de disgust", TOXIC, "abschaum dreck müll ekelhaft widerlich erbärmlich wertlos ungeziefer scheiße"),
    ("de hostility", TOXIC, "hasse verpiss maul arschloch schwein sau hurensohn feigling"),
    ("es insults", TOXIC, "idiota idiotas imbécil estúpido estúpida tonto tonta bobo necio inútil perdedor fracasado payaso"),
    ("es disgust", TOXIC, "basura asqueroso asquerosa escoria repugnante despreciable patético patética mierda"),
    ("es hostility", TOXIC, "odio odiar muérete cállate cabrón puta gilipollas pendejo cobarde"),
    ("it insults", TOXIC, "idiota stupido stupida cretino scemo deficiente imbecille schifoso spazzatura merda stronzo"),
    ("pt insults", TOXIC, "idiota burro burra estúpido imbecil lixo nojento inútil otário merda palhaço"),
    ("nl insults", TOXIC, "idioot stomkop sukkel waardeloos walgelijk afval schoft lafaard klootzak"),
    ("ru insults", TOXIC, "идиот дурак тупой мразь ничтожество урод подонок"),
    ("en courtesy", CLEAN, "please thanks thank welcome kindly sorry appreciate grateful regards sincerely dear"),
    ("en praise", CLEAN, "excellent wonderful helpful great friendly lovely delightful beautiful"),
    ("fr courtesy", CLEAN, "merci bonjour bienvenue cordialement désolé pardon cher chère volontiers"),
    ("de courtesy", CLEAN, "bitte danke willkommen grüße freundlich entschuldigung gerne"),
    ("es courtesy", CLEAN, "gracias bienvenido bienvenida saludos estimado perdón amable favor"),
    ("legal prose", CLEAN, "license licensed copyright warranty redistribution permission liability herein conditions"),
    ("scholarly prose", CLEAN, "theorem abstract section figure table references hypothesis dataset method analysis"),
    ("reporting", CLEAN, "reported according announced minister percent yesterday government"),
    ("commerce", CLEAN, "shipping price order delivery discount customer invoice"),
    ("instructions", CLEAN, "click select install configure step menu button following"),
]
#: Who is spoken to, and forms of "be" behind or before it.
ADDRESS = "you your tu toi vous du dich ihr eres tú usted sei você jij ты"
#: The lists of toxic words come first.
INSULTS = sum(polarity == TOXIC for _, polarity, _ in LEXICONS)

#: name, polarity, least uses
PATTERNS = [
    ("shouted words", TOXIC, 3),
    ("exclamation runs", TOXIC, 1),
    ("masked swear words", TOXIC, 1),
    ("insult near an address", TOXIC, 1),
    ("insult twice", TOXIC, 2),
    ("links", CLEAN, 1),
    ("figures", CLEAN, 5),
]


def features(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
    """(row, feature) of all words and word beginnings, and the words of each row.

    The words come first, in order.
    """
    starts, ends, counts = hasher.spans(data, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, keys = [row], [hasher.hashes(data, starts, ends)]
    for k, width in enumerate(BEGINNINGS):
        longer = ends - starts > width
        s = starts[longer]
        salt = mix64(np.array([k + 1], np.uint64))
        rows.append(row[longer])
        keys.append(hasher.hashes(data, s, s + width) ^ salt)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), counts


def _hasher() -> WordHasher:
    return WordHasher(lower=True, word_bytes=LETTERS)


def word_keys(words: str) -> np.ndarray:
    """Features of listed words."""
    data = np.frombuffer(words.encode(), np.uint8)
    hasher = _hasher()
    starts, ends, _ = hasher.spans(data, np.array([0, len(data)]))
    return np.unique(hasher.hashes(data, starts, ends)).view(np.int64)


def _present(batches) -> Iterator:
    """Distinct features of the sampled texts."""
    import pyarrow as pa

    hasher = _hasher()
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in TextChunks(batch.column(0), 1 << 20):
            row, key, _ = features(data, offsets, hasher)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[new]), pa.array(toxic[lo:hi][row[new]].astype(np.int32))],
                ["key", "toxic"],
            )


class _Lookup:
    """Which of some features are listed, and in which columns; a feature may have several."""

    def __init__(self, keys: np.ndarray, columns: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.columns = keys[order], columns[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.keys.view(np.uint64) & np.uint64(0xFFFF)] = True

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``key``, column) of every listed one."""
        some = np.flatnonzero(self.maybe[key.view(np.uint64) & np.uint64(0xFFFF)])
        first = np.searchsorted(self.keys, key[some])
        many = np.searchsorted(self.keys, key[some], side="right") - first
        some, first, many = some[many > 0], first[many > 0], many[many > 0]
        each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(some, many), self.columns[np.repeat(first, many) + each]


class Counter:
    """Uses of every voter's pattern in texts: word lists, forms, then suggested features."""

    def __init__(self, suggested: np.ndarray):
        listed = [word_keys(words) for _, _, words in LEXICONS]
        n = len(LEXICONS) + len(PATTERNS)
        self.columns = n + len(suggested)
        self.lookup = _Lookup(
            np.concatenate([*listed, suggested]),
            np.concatenate(
                [*(np.full(len(k), i) for i, k in enumerate(listed)), n + np.arange(len(suggested))]
            ).astype(np.int64),
        )
        self.address = _Lookup(word_keys(ADDRESS), np.zeros(len(word_keys(ADDRESS)), np.int64))
        self.hasher = _hasher()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (rows by voters) and words of every row."""
        row, key, words = features(data, offsets, self.hasher)
        n, k, lists = len(words), self.columns, len(LEXICONS)
        at, column = self.lookup(key)
        out = np.bincount(row[at] * k + column, minlength=n * k).reshape(n, k)
        total = int(words.sum())
        insult = np.zeros(total, bool)
        insult[at[(at < total) & (column < INSULTS)]] = True
        out[:, lists : lists + len(PATTERNS)] = self._forms(data, offsets, row[:total], key[:total], insult, n)
        return out.astype(np.float32), words

    def _forms(self, data, offsets, row, key, insult, n) -> np.ndarray:
        of = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
        by_word = lambda mask: np.bincount(row[mask], minlength=n)
        starts, ends, _ = self.hasher.spans(data, offsets)
        upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
        shouted = (ends - starts >= 4) & (upper[ends] - upper[starts] == ends - starts)
        bang, star = data == 33, data == 42
        runs = bang.copy()
        runs[1:] &= bang[:-1]
        runs[:1] = False
        letter = LETTERS[data] & (data < 128)
        masked = np.zeros(len(data), bool)
        if len(data) > 2:  # a letter, stars, and no letter pair right before: f**k, s***
            masked[1:-1] = star[1:-1] & letter[:-2] & star[2:]
        spoken = np.zeros(len(key), bool)
        spoken[self.address(key)[0]] = True
        near = np.zeros(len(key), bool)
        for step in (1, 2, 3):
            same = row[step:] == row[:-step]
            near[step:] |= spoken[:-step] & same
            near[:-step] |= spoken[step:] & same
        digit = (data >= 48) & (data <= 57)
        first_digit = digit.copy()
        first_digit[1:] &= ~digit[:-1]
        slash = data == 47
        link = np.zeros(len(data), bool)
        if len(data) > 2:
            link[2:] = slash[2:] & slash[1:-1] & (data[:-2] == 58)
        return np.stack(
            [by_word(shouted), of(runs), of(masked), by_word(insult & near), by_word(insult),
             of(link), of(first_digit)], axis=1,
        )


def votes_of(counts: np.ndarray) -> np.ndarray:
    """1 where a voter speaks, 0 where it abstains."""
    least = np.ones(counts.shape[1], np.float32)
    least[len(LEXICONS) : len(LEXICONS) + len(PATTERNS)] = [uses for _, _, uses in PATTERNS]
    return (counts >= least).astype(np.float32)


def design(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Presence and rate of every pattern."""
    rate = np.log1p(1000.0 * counts / np.maximum(words, 20)[:, None]) / 7.0
    return np.concatenate([counts > 0, rate], axis=1).astype(np.float32)


@dataclass
class Model:
    """A fitted classifier, and what the label model estimated: how often each voter
    fires given clean and toxic, and the tree of correlated voters."""

    suggested: np.ndarray
    weights: np.ndarray
    bias: float
    rates: np.ndarray
    parents: np.ndarray

    def score(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = design(counts, words) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _spanning_tree(weight: np.ndarray, least: float) -> np.ndarray:
    """Parents in the heaviest spanning forest of edges above ``least`` (-1: a root)."""
    k = len(weight)
    parent = np.full(k, -1)
    best, via, open_ = np.zeros(k), np.full(k, -1), np.ones(k, bool)
    for _ in range(k):
        i = int(np.argmax(np.where(open_, best, -1.0)))
        open_[i] = False
        parent[i] = via[i]
        closer = open_ & (weight[i] > np.maximum(best, least))
        best[closer], via[closer] = weight[i][closer], i
    return parent


def _joint(votes: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, single and pair counts of the votes under row weights ``share``."""
    weighted = votes * share[:, None].astype(np.float32)
    return float(share.sum()), weighted.sum(axis=0, dtype=np.float64), (weighted.T @ votes).astype(np.float64)


def _information(total: float, one: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Nats of mutual information of every two voters, by their counts, times ``total``."""
    n = total + 1e-9
    out = np.zeros_like(pair)
    a, b = one[:, None], one[None, :]
    cells = [(pair, a, b), (a - pair, a, n - b), (b - pair, n - a, b), (n - a - b + pair, n - a, n - b)]
    for cell, x, y in cells:
        cell = np.maximum(cell, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(cell > 0, cell * np.log(cell * n / np.maximum(x * y, 1e-12)), 0.0)
    return np.maximum(out, 0.0)


def label_model(
    votes: np.ndarray, polarity: np.ndarray, prior: float, known: list | None = None,
    *, rounds: int = 40, edge_nats: float = 6.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of "toxic" for each row, rates, parents), from the votes alone.

    ``votes``: rows by voters, 1 where a voter speaks; ``polarity``: what it then
    says; ``prior``: the share of toxic rows.  Rates are P(speaks | clean) and
    P(speaks | toxic); a voter with a parent in the tree has two of either, for a
    speaking and a silent parent.  The tree is estimated anew each few rounds
    until half of them are over; correlations of less than ``edge_nats`` aren't
    modelled.  ``known`` are counts (as of ``_joint``) of clean and toxic
    development rows: the prior of the rates.
    """
    n, k = votes.shape
    prior = float(np.clip(prior, 0.001, 0.999))
    odds = np.log(prior / (1 - prior))
    rates, parents = np.zeros((2, k)), np.full(k, -1)
    if not n or not k:
        return np.full(n, prior), rates, parents
    # to begin with: right nine times of ten, or as often as its number of votes allows
    share = votes.mean(axis=0, dtype=np.float64)
    most = np.where(polarity > 0, prior, 1 - prior)
    trust = np.clip(most / np.maximum(share, 1e-9), None, 0.9)
    start = np.maximum(np.log(trust / (1 - trust)) - np.log(most / (1 - most)), 0.0)
    posterior = 1.0 / (1.0 + np.exp(-np.clip(odds + votes @ (start * polarity), -8, 8)))
    for step in range(rounds):
        joint = [_joint(votes, 1 - posterior), _joint(votes, posterior)]
        if known is not None:
            joint = [tuple(x + p for x, p in zip(j, q, strict=True)) for j, q in zip(joint, known, strict=True)]
        if step >= 4 and step % 4 == 0 and step <= rounds // 2:
            weight = sum(_information(*j) for j in joint)
            np.fill_diagonal(weight, 0.0)
            parents = _spanning_tree(weight, edge_nats)
        root = parents < 0
        up = np.where(root, 0, parents)
        above = votes[:, up] * ~root
        z = np.full(n, odds)
        for y, sign in ((1, 1.0), (0, -1.0)):
            total, one, pair = joint[y]
            p = rates[y] = (one + 0.5 * share) / (total + 0.5)
            both = pair[np.arange(k), up]
            on = np.where(root, p, (both + 2.0 * p) / (one[up] + 2.0))
            off = np.where(root, p, (one - both + 2.0 * p) / (total - one[up] + 2.0))
            on, off = (np.clip(x, 1e-9, 1 - 1e-9) for x in (on, off))
            on1, on0, off1, off0 = np.log(on), np.log(1 - on), np.log(off), np.log(1 - off)
            z += sign * (
                off0.sum() + votes @ (off1 - off0) + above @ (on0 - off0)
                + (votes * above) @ (on1 - on0 - off1 + off0)
            )
        after = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(after - posterior).max()
        posterior = after
        if moved < 1e-4 and step > rounds // 2:
            break
    return posterior, rates, parents


def logistic(x: np.ndarray, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4):
    """Weights and bias of the logistic regression of soft targets (Nesterov steps)."""
    n, k = x.shape
    x = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    target = target.astype(np.float32)
    w = v = np.zeros(k + 1, np.float32)
    # the largest curvature, by power iteration
    u = np.ones(k + 1, np.float32)
    for _ in range(12):
        u = x.T @ (x @ (u / np.linalg.norm(u)))
    step = np.float32(1.0 / (0.25 * np.linalg.norm(u) / n + ridge))
    w[-1] = v[-1] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
    for i in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (p - target) / n + np.float32(ridge) * np.append(v[:-1], np.float32(0))
        after = v - step * grad
        w, v = after, after + np.float32(i / (i + 3)) * (after - w)
    return w, float(w[-1])


def _suggestions(sample: DataFrame, voters: int) -> np.ndarray:
    """Features that the first half of the sample suggests and the second confirms."""
    sums = sample.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).collect()
    n = {r["half"]: (r["n"], r["n1"]) for r in sums}  # two rows
    (n_a, n1_a) = n.get(0, (0, 0))
    if not n1_a:
        return np.zeros(0, np.int64)
    of = lambda half, toxic: F.sum(
        ((F.col("half") == half) & (F.col("toxic") == toxic)).cast("long")
    )
    share1 = (F.col("a1") + 0.1) / (n1_a + 0.2)
    share0 = (F.col("a0") + 0.1) / (n_a - n1_a + 0.2)
    halves = [
        sample.where(F.col("half") == h).select("text", "toxic")
        .mapInArrow(_present, "key long, toxic int").withColumn("half", F.lit(h))
        for h in (0, 1)
    ]
    ranked = (
        halves[0].unionByName(halves[1])
        .groupBy("key")
        .agg(of(0, 1).alias("a1"), of(0, 0).alias("a0"), of(1, 1).alias("b1"), of(1, 0).alias("b0"))
        .where(F.col("a1") >= max(3, LEAST_SUPPORT * n1_a))
        .where((F.col("a1") - 1.5 * F.sqrt("a1")) / n1_a > 3 * share0)
        .where((F.col("b1") >= 2) & (F.col("b1") / (F.col("b1") + F.col("b0") + 1) >= 0.6))
        .select("key", (share1 * F.log(share1 / share0)).alias("gain"))
        .orderBy(F.desc("gain"), "key")
        .limit(voters)
    )
    return np.sort(ranked.toArrow().column("key").to_numpy())  # at most ``voters`` rows


def _squeezed(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int32).tobytes())


def _counted(sample: DataFrame, suggested: np.ndarray):
    """On the driver, for at most the sample's rows: half, label, words and voters' counts."""
    import zstandard

    def run(batches) -> Iterator:
        import pyarrow as pa

        count = Counter(suggested)
        for batch in batches:
            labels = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int32) for i in (1, 2)]
            for lo, hi, data, offsets in TextChunks(batch.column(0), 1 << 20):
                found, words = count(data, offsets)
                rows = [x[lo:hi].tobytes() for x in labels]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (*rows, words.astype(np.int64).tobytes(), _squeezed(found))],
                    ["toxic", "half", "words", "counts"],
                )

    table = sample.select("text", "toxic", "half").mapInArrow(
        run, "toxic binary, half binary, words binary, counts binary"
    ).toArrow()
    blobs = {c: table.column(c).to_pylist() for c in table.column_names}
    toxic, half = (np.frombuffer(b"".join(blobs[c]), np.int32) for c in ("toxic", "half"))
    words = np.frombuffer(b"".join(blobs["words"]), np.int64)
    opened = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in blobs["counts"])
    counts = np.frombuffer(opened, np.int32).reshape(len(toxic), -1).astype(np.float32)
    return toxic, half, words, counts


def fit(train: DataFrame, *, sample_rows: int = SAMPLE_ROWS, voters: int = SUGGESTED) -> Model:
    """A model from ``train(doc_id, text, toxic)``, of at most ``sample_rows`` rows.

    More rows are an error: ``training_rows`` draws them.  Labels are used to
    suggest voters (one half of the rows), to confirm them and to set the prior
    of their rates (the other half), and for the share of toxic texts; the
    classifier's targets are the label model's posteriors.  Without toxic or
    without clean rows the score is a constant near 0 or 1.
    """
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    sample = staged(train.select("text", F.col("toxic").cast("int").alias("toxic"), half.alias("half")), "sample")
    sums = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, n1 = int(sums[0]), int(sums[1])
    if n > sample_rows:
        raise ValueError(f"{n} training rows, more than sample_rows={sample_rows}")
    none = np.zeros(0, np.int64)
    if not n1 or n1 == n:
        k = Counter(none).columns
        return Model(none, np.zeros(2 * k, np.float32), 6.0 if n1 else -6.0, np.zeros((2, k)), np.full(k, -1))
    suggested = _suggestions(sample, voters)
    toxic, part, words, counts = _counted(sample, suggested)
    votes = votes_of(counts)
    polarity = np.array(
        [p for _, p, _ in LEXICONS] + [p for _, p, _ in PATTERNS] + [TOXIC] * len(suggested)
    )
    # development rows: hand-written voters that do worse than chance there abstain
    seen, truth = votes[part == 1], toxic[part == 1].astype(np.float32)
    known = [_joint(seen, DEVELOPMENT_WEIGHT * (1 - truth)), _joint(seen, DEVELOPMENT_WEIGHT * truth)]
    right, uses = truth @ seen, seen.sum(axis=0)
    share = n1 / n
    precision = (right + 1) / (uses + 1 / share)
    sound = np.where(polarity > 0, precision > 2 * share, precision < share) | (uses < 5)
    use = sound & (votes.sum(axis=0) > 0)
    kept = [(t, one[use], pair[np.ix_(use, use)]) for t, one, pair in known]
    posterior, some, tree = label_model(votes[:, use], polarity[use], share, kept)
    rates, parents = np.zeros((2, len(use))), np.full(len(use), -1)
    rates[:, use] = some
    places = np.flatnonzero(use)
    parents[use] = np.where(tree < 0, -1, places[tree]) if len(places) else tree
    weights, bias = logistic(design(counts, words), posterior)
    return Model(suggested, weights[:-1], bias, rates, parents)


def training_rows(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Labelled training texts: at most ``sample_rows``, drawn by hash of doc_id.

    Rows whose crc32(doc_id) modulo 4 is 2 are held out.  Null labels don't
    count; of several labels of a document, the larger one does; of several
    texts of a doc_id, the least one.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(crc32_of_id(F.col("doc_id")) % 4 != 2)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        texts.join(F.broadcast(known), "doc_id")  # at most ``sample_rows`` numbers
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "toxic")
    )


def score_toxicity(
    df: DataFrame, model: Model, *, threshold: float = THRESHOLD,
    score_col: str = "toxicity", flag_col: str = "toxic",
) -> DataFrame:
    """``df`` with ``score_col`` (0 to 1) and ``flag_col`` (score at least ``threshold``).

    Null or empty texts get the score of a text without any pattern.  Rows stay
    one to one, repeated rows and null ids included.  All columns of ``df`` pass
    through, but for columns of the two result names, which are replaced.  An
    empty table gives no rows; a very long text is one row as any other.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (score_col, flag_col)])
    names = df.columns
    at = names.index("text")
    schema = df.select("*", F.lit(0.0).alias(score_col), F.lit(False).alias(flag_col)).schema

    def run(batches) -> Iterator:
        import pyarrow as pa

        count = Counter(model.suggested)
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in TextChunks(batch.column(at)):
                scores.append(model.score(*count(data, offsets)).astype(np.float64))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(score >= threshold)],
                [*names, score_col, flag_col],
            )

    return df.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(training_rows(docs, documents(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc32_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
    )
