"""Secret spans against a plain regular-expression version, and the models on strings they have not seen."""

import base64
import hashlib
import random
import re

import pytest

from equipoise.llm import secrets
from equipoise.llm.secrets import ALPHABET, NAMES, find_secrets, labelled_strings, markov_ratios, secret_digests

PATTERNS = [
    (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
]


def plain_base(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= n]
    return sorted(found)


def plain_random(text, base, ratios):
    """Every run of the text with the base spans blanked, by the sum of its ratios alone."""
    chars = list(text or "")
    for a, _, b in base:
        chars[a:b] = " " * (b - a)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{2,}", "".join(chars)):
        if is_random(m[0], ratios):
            out.append((m.start(), 3, m.end()))
    return out


def is_random(run, ratios):
    at = [ALPHABET.index(c) for c in run]
    mean = sum(ratios[a * len(ALPHABET) + b] for a, b in zip(at, at[1:])) / (len(at) - 1)
    return mean > max(secrets.MIN_RATIO, secrets.MIN_RATIO * (secrets.LONG - 1) / (len(at) - 1))


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return markov_ratios(labelled_strings(spark, docs, "doc_id", "text"))


def hashed(i, n=30):
    return base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[:n]


def texts():
    rng = random.Random(4)
    parts = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", '"', "'", " ", ":", "=", "é", "𝒳", "abc123", "hunter2x", "AKIA", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "deadbeef", "\n", "--", hashed(5)]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    out += [None, "", "password=token:abcdefgh", "𝒳𝒳 token = 'abc.def' é " + hashed(1), "ſecret=abcdefgh toKen=abcdefgh", "x" * 200_000 + " secret: " + "z" * 50, "passwd='" + "a" * 5 + "'"]
    return out


def test_spans_are_those_of_the_patterns(spark, ratios):
    rows = list(enumerate(texts())) + [(None, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "token=abcdefgh")]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, spans string")
    got = find_secrets(docs, ratios=ratios).collect()
    assert len(got) == len(rows)
    seen = sorted((str(r["doc_id"]), [tuple(s) for s in r["base_spans"]], [tuple(s) for s in r["spans"]]) for r in got)
    want = []
    for k, t in rows:
        base = plain_base(t)
        want.append((str(k), base, sorted(base + plain_random(t, base, ratios))))
    assert seen == sorted(want)


def test_counts_are_those_of_the_kinds(spark, ratios):
    values = [*texts(), "token=abcdefgh token=abcdefgh", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2 + " secret: abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in find_secrets(docs, ratios=ratios).collect()}
    want = {i: tuple(sum(k == kind for _, k, _ in plain_base(t)) for kind in range(3)) for i, t in enumerate(values)}
    assert got == want and len(set(want.values())) > 5


def test_models_tell_unseen_strings_apart(spark, ratios):
    drawn = [hashed(f"unseen {i}", 24) for i in range(200)]
    names = ["request_handler_timeout_seconds2", "getAccountBalanceForUser42", "max_retry_count_per_host_10", "src/main/java/org/example/App1", "content-security-policy-report-2"] * 10
    table = spark.createDataFrame([(i, t) for i, t in enumerate(drawn + names)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_random"] for r in find_secrets(table, ratios=ratios).collect()}
    assert sum(got[i] for i in range(200)) >= 195 and sum(got[i] for i in range(200, 250)) == 0


def test_empty_table(spark):
    assert secret_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_patterns(spark, ratios):
    from equipoise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    written = lambda spans: ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)
    for r in QUERIES["op9_secrets"](spark, sf).collect():
        base = plain_base(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert r["spans"] == written(sorted(base + plain_random(docs[r["doc_id"]], base, ratios)))


def test_every_run_is_scored(spark, ratios):
    rng = random.Random(8)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    drawn = [[(a, n), "".join(rng.choice(a) for _ in range(n))] for a in (letters, letters + digits, digits + ALPHABET[62:]) for n in (8, 16, 17, 24, 40) for _ in range(40)]
    values = texts() + [f"é {'AKIA' + 'Q7' * 10}={hashed(i, 40)} and secret: {hashed(i)}.x" for i in range(20)] + [s for _, s in drawn]
    table = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_secrets(table, ratios=ratios).collect()}
    for i, t in enumerate(values):
        want = plain_random(t, plain_base(t), ratios)
        assert [tuple(s) for s in got[i]["random_spans"]] == want and got[i]["n_random"] == len(want)
        assert [tuple(s) for s in got[i]["spans"]] == sorted(plain_base(t) + want)
    key = len(texts())
    assert sum(got[i]["n_random"] for i in range(key, key + 20)) >= 19  # what follows an access key in the same run
    found = {}
    for i, (kind, _) in enumerate(drawn, key + 20):
        found[kind] = found.get(kind, 0) + got[i]["n_random"]
    assert all(found[a, n] >= 36 for a in (letters, letters + digits) for n in (16, 17, 24, 40))


def test_rules_are_not_random(spark, ratios):
    table = spark.createDataFrame([(i, c * n) for i, c in enumerate(ALPHABET) for n in (2, 20, 80)], "doc_id long, text string")
    assert find_secrets(table, ratios=ratios).where("n_random > 0").count() == 0


def test_models_count_all_forms_of_all_triples(spark):
    from pyspark.sql import functions as F

    texts = ["Some words here, and then more of them; the end", "two words", "alpha Beta GAMMA", "alpha Beta GAMMA delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [[w for w in re.split("[^A-Za-z]+", t) if len(w) >= 2] for t in texts]
    triples = spark.createDataFrame([(w[i : i + 3],) for w in words for i in range(len(w) - 2)], "p array<string>")
    want = {}
    for r in triples.withColumn("n", F.expr("pmod(xxhash64(p), 1000)").cast("string")).collect():
        low = [w.lower() for w in r["p"]]
        rest = "".join(w.capitalize() for w in low[1:])
        forms = ["_".join(low), "-".join(low), low[0].capitalize() + rest, "_".join(low).upper(), "_".join(low) + "_" + r["n"], "/".join(low) + r["n"], low[0] + rest, low[0].upper() + rest]
        for f in forms:
            for pair in zip(f, f[1:]):
                want[pair] = want.get(pair, 0) + 1
    got = {}
    for r in labelled_strings(spark, docs, "doc_id", "text").where("NOT random AND NOT made").collect():
        for pair in zip(r["string"], r["string"][1:]):
            got[pair] = got.get(pair, 0) + r["times"]
    assert got == want


HELD_OUT = """network interface protocol buffer stream channel socket thread process kernel memory cache queue stack heap tree graph node edge vertex matrix
vector tensor layer neuron weight gradient optimizer scheduler trainer dataset loader sampler embedding attention invoice payment shipping discount
currency exchange market stock future hedge portfolio schwarz muller garcia martinez rodriguez wolfgang amadeus mozart theophilus ludwig beethoven
tcp udp ssl tls ssh ftp smtp dns gpu cpu ram usb pdf png jpeg utf ascii""".split()  # none of them is a word that the models are trained on


def ordinary(rng):
    """Strings of each ordinary kind that the models have not seen."""
    import datetime
    import uuid

    out = {}
    for _ in range(400):
        w = [rng.choice(HELD_OUT) for _ in range(rng.randrange(2, 5))]
        at = datetime.datetime(2001, 1, 1) + datetime.timedelta(seconds=rng.randrange(800_000_000))
        out.setdefault("snake", []).append("_".join(w) + rng.choice(["", f"_{rng.randrange(100)}"]))
        out.setdefault("camel", []).append(w[0] + "".join(x.capitalize() for x in w[1:]))
        out.setdefault("acronym", []).append("".join(x.upper() if len(x) < 4 else x.capitalize() for x in w))
        out.setdefault("path", []).append("/".join(w) + str(rng.randrange(10)))
        out.setdefault("date", []).append(at.strftime(rng.choice(["%Y-%m-%d", "%Y-%m-%dT%H-%M-%S", "%Y%m%d%H%M%S", "%Y/%m/%d/%H"])))
        out.setdefault("number", []).append(str(rng.randrange(10 ** rng.randrange(4, 30))))
        out.setdefault("uuid", []).append(str(uuid.UUID(int=rng.getrandbits(128))))
    return out


def test_precision_and_recall_by_kind(spark, ratios):
    rng = random.Random(17)
    wrong = {kind: sum(is_random(s, ratios) for s in strings) for kind, strings in ordinary(rng).items()}
    assert sum(wrong.values()) <= 0.01 * 400 * len(wrong) and max(wrong.values()) <= 0.025 * 400, wrong
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    found = []
    for alphabet in (ALPHABET[:64], letters + digits, letters, letters[:26] + digits, letters[26:] + digits, letters[:26], letters[26:]):
        for n in (16, 20, 24, 32, 40):
            hits = [is_random("".join(rng.choice(alphabet) for _ in range(n)), ratios) for _ in range(200)]
            found += hits
            assert sum(hits) >= (160 if n == 16 else 180), (alphabet, n)
    assert sum(found) >= 0.95 * len(found)
    for name in ("XMLHttpRequestFactoryBuilder", "2026-12-04T05-47-21", "WolfgangAmadeusTheophilusMozartSmith", "123e4567-e89b-12d3-a456-426614174000"):
        assert not is_random(name, ratios), name


def test_samples_have_the_forms_they_say(spark):
    drawn = [r["string"] for r in secrets.drawn_strings(spark, 700).collect()]
    assert [set(drawn[i]) <= set(secrets.DRAWN[i % 7]) for i in range(700)] == [True] * 700 and {len(s) for s in drawn} == set(range(20, 44))
    values = [r["string"] for r in secrets.ordinary_values(spark, 200).collect()]
    assert len(values) == 2200 and sum(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", s)) for s in values) == 200
    assert all(len(r["p"]) == 3 and all(r["p"]) for r in secrets.common_triples(spark, 50).collect())
