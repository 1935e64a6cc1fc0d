"""Operators over texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tamis.llm import byte_bpe, decontaminate, pii, secrets, sharding, simhash

ODD = [
    "", None, "x", "  \n ", "a b", "A B", "a  b", "é😀 naïve ıİ K", "tok" * 5000, "word " * 4000, "1" * 9000, "1-" * 5000, "a.b" * 4000 + "@x.org",
    'token = "abcdefgh12345678" password: s3cr3tpass API_key=ABCDEFGH', "AKIA" + "Q" * 16 + " " + "0f" * 20, "ghp_" + "a" * 36,
    "me@x.org, you@a.b.c_z@d.e +49 (30) 123-4567 10.0.0.1 1.2.3.400 4111 1111 1111 1111 4111111111111112", "call (212) 555-1234 ssn 123-45-6789",
    "one two three four five six seven eight nine ten eleven", "ONE two three four five six seven eight nine ten, eleven! one two three",
    "short item here", "before short item here after", " nbsp word x", "tab\there\r\nline\x0bfeed",
]
SCHEMA = "doc_id long, text string, hash long, key string, shard int, spans int, t string, items string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 2, 3, "t", "i") for i, t in enumerate(ODD)] + [(2, "x", 1, "k", 2, 3, "t", "i")] * 2 + [(None, "x y z", 0, None, 0, 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def listing(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_secrets(text):
    spans = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


def base_pii(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_secrets_match_plain_regexes(docs):
    rows = secrets.digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "x y z" if r.doc_id is None else ODD[r.doc_id] or ""
        want = base_secrets(text)
        assert r.base_sha256 == sha(listing(want)) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, *_ in want) for n in ("assign", "access", "hex")]
        assert set(listing(want).split(",")) <= set(r.spans.split(",")) or not want
    assert any("github" in r.spans for r in rows)


def test_secret_queries_are_necessary():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex"), rule.kind
    assert secrets.trigram_query("ab|cd") is True and secrets.trigram_query("abc(de)?f") != True  # noqa: E712


def test_redaction_keeps_clean_texts(docs):
    kept = {(r.doc_id, r.text) for r in secrets.redact(docs, ["doc_id", "text"]).collect()}
    assert (0, "") in kept and (1, None) in kept and (4, "a b") in kept
    assert (14, "[access] [hex]") in kept


def test_personal_data_matches_plain_regexes(docs):
    rows = pii.digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "x y z" if r.doc_id is None else ODD[r.doc_id] or ""
        want = base_pii(text)
        assert r.base_sha256 == sha(listing(want)), (text[:80], r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in want) for n in ("email", "ip", "card", "phone")]
    assert pii.digest(docs.limit(0)).count() == 0


def test_reliabilities_follow_the_votes():
    good, bad = (1, 1, 1, 1, 0), (-1, 0, 0, -1, -1)
    model = pii.fit([("card", good, 900), ("card", bad, 500), ("card", (1, 0, 0, 1, 0), 50)])
    clean, personal = model.reliability["card", "format"]
    assert personal[2] > 0.9 > 0.5 > clean[2] and model.weights["card", "format", 1] > model.weights["card", "format", -1]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_all_within_the_radius(spark, docs):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()}
    items = [(i, brute_simhash(t)) for i, t in enumerate(ODD)]
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in items:
        for j, b in items:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r for r in rows if r[0] is not None} == {(i, f"{f:016x}", find(i)) for i, f in items}


def test_covering_tables_miss_no_pair():
    masks = simhash.table_masks()
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_chain_of_fingerprints_is_one_class(spark):
    from tamis.session import Scratch

    words = [sum(1 << b for b in range(0, 2 * k, 1)) for k in range(20)] + [(1 << 62) | (1 << 50) | (1 << 45)]
    edges = simhash.links(spark.createDataFrame([(w,) for w in words], "fp long"), Scratch(spark, "test"))
    found = simhash.connected_components(edges, Scratch(spark, "test")).collect()
    assert {r.u for r in found} == set(words[1:20]) and {r.v for r in found} == {0}


def test_one_document_of_a_group_stays(docs):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 1 and 0 in ids and 1 not in ids and 5 not in ids


def brute_windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words


BENCHMARK = [(7, "one two three four five six seven eight nine ten"), (8, "Short ITEM here"), (9, ""), (10, None), (11, "a"), (12, "short item here")]


def test_decontamination_matches_brute_force(spark, docs):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    for most in (10**6, 0):
        rows = decontaminate.contamination(docs, bench, most_broadcast=most).collect()
        assert len(rows) == docs.count()
        for r in rows:
            words = brute_windows("x y z" if r.doc_id is None else ODD[r.doc_id])
            hit, items = set(), set()
            for item, text in BENCHMARK:
                own = brute_windows(text)
                n = min(10, len(own))
                grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
                for i in range(len(words) - n + 1):
                    if tuple(words[i : i + n]) in grams:
                        hit |= set(range(i, i + n))
                        items.add(str(item))
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(words), len(hit), sorted(items), bool(hit)), ODD[r.doc_id or 0]
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_removal_keeps_the_rest(spark, docs):
    bench = spark.createDataFrame(BENCHMARK[:2], "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, ["doc_id", "text"]).collect()}
    assert 18 not in kept and 19 not in kept and 20 not in kept  # mostly benchmark
    assert kept[1] is None and kept[9] == "word " * 4000
    more = spark.createDataFrame([(1, "It was said: short item here, and (then) no more.")], "doc_id long, text string")
    assert decontaminate.remove(more, bench, ["text"]).head().text == "It was said: and (then) no more."


def test_jump_hash_moves_only_to_the_new_shard(docs):
    rows = sharding.assign_shards(docs, 24).collect()
    assert len(rows) == docs.count() and all(r.grown_shard in (r.shard, 24) for r in rows)

    def jump(key, n):  # the published loop
        b, j = -1, 0
        while j < n:
            b, key = j, (key * sharding.MULTIPLIER + 1) & (1 << 64) - 1
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 24) and r.grown_shard == jump(r.doc_id or 0, 25)
        text = "x y z" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bpe_equals_the_public_encoder(docs):
    path, pattern = byte_bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in byte_bpe.round_trip(docs, path, pattern).collect():
        text = "x y z" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.tokenise(docs, path, pattern).where("not exact").count() == 0
    back = docs.select("text", byte_bpe.decode(byte_bpe.encode(F.col("text"), path, pattern), path, pattern).alias("back"))
    assert back.where("coalesce(text, '') <> back").count() == 0
