"""Operators with exact answers, against brute force: fingerprints, lengths, archives, shards."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest

from quillmark.llm import fingerprint, lengths, sharding, warc

KIND = "doc_id long, text string"


def documents(n=60, seed=1):
    rng = random.Random(seed)
    words = "the Straße ＡＢＣ ﬁne Été été NAÏVE á x y 𝔘 tail ".split(" ")
    rows = [(i * 7 % 101, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 80])))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "  The  TAIL\n"), (503, "the tail"), (504, "w" * 30_000)]


def test_fingerprints_follow_the_contract(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in fingerprint.edit_report(spark.createDataFrame(rows, KIND).repartition(5)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.digest(fingerprint.canonical(text))
        assert r["edited_fingerprint"] == fingerprint.digest(fingerprint.canonical(edited))
        assert r["near_edited"] == float(fingerprint.canonical(text) == fingerprint.canonical(edited))
        assert r["near_next"] == float(fingerprint.canonical(text) == fingerprint.canonical(following))
    assert got[502]["fingerprint"] == got[503]["fingerprint"]


def test_canonical_form():
    assert fingerprint.canonical("ＡＢＣ\t ﬁne  Straße") == "abc fine strasse"
    assert fingerprint.canonical("Été") == fingerprint.canonical("Été")
    assert fingerprint.canonical(None) == ""


def test_bytes_that_share_a_digest_are_told_apart(spark):
    held = spark.createDataFrame([("d", bytearray(b"one")), ("d", bytearray(b"two")), ("d", bytearray(b"two")), ("e", bytearray(b"x"))], "digest string, bytes binary")
    got = {(r["digest"], bytes(r["bytes"])): r["suffix"] for r in fingerprint.variants(held).collect()}
    assert got == {("d", b"one"): "", ("d", b"two"): "-1"}


def test_fingerprint_edge_cases(spark):
    assert fingerprint.edit_report(spark.createDataFrame([], KIND)).count() == 0
    single = fingerprint.edit_report(spark.createDataFrame([(3, "abcdef")], KIND)).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and single["near_next"] == 1.0
    rows = [(1, "abc"), (1, "abc"), (None, "xyz"), (2, None)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'c' digest", "0 range", "1 kind", "2 border")
    assert fingerprint.edit_report(df).count() == 4
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert plain[1] == fingerprint.digest("abc") and len(plain) == 3


def test_lengths_match_brute_force(spark):
    encoding = lengths.load_encoding(lengths.VOCABULARY)
    rows = documents(40, 2)
    sizes = Counter(len(encoding.encode_ordinary(t or "")) for _, t in rows)
    got = {r["length"]: r for r in lengths.token_lengths(spark.createDataFrame(rows, KIND)).collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == dict(sizes)
    total = sum(k * n for k, n in sizes.items())
    for limit, r in got.items():
        assert r["docs_over"] == sum(n for k, n in sizes.items() if k > limit)
        assert r["tokens_within"] == sum(k * n for k, n in sizes.items() if k <= limit)
        assert r["truncated_total"] == sum(min(k, limit) * n for k, n in sizes.items())
        assert r["total_tokens"] == total and r["cut_tokens"] == total - r["truncated_total"]
    asked = [0, 5, 17, 10**6]
    answers = {r["limit"]: r for r in lengths.at_limits(lengths.token_lengths(spark.createDataFrame(rows, KIND)), asked).collect()}
    for limit in asked:
        assert answers[limit]["truncated_total"] == sum(min(k, limit) * n for k, n in sizes.items())
        assert answers[limit]["docs_within"] == sum(n for k, n in sizes.items() if k <= limit)


def test_lengths_of_nothing(spark):
    assert lengths.token_lengths(spark.createDataFrame([], KIND)).count() == 0
    only = lengths.token_lengths(spark.createDataFrame([(1, None), (1, "")], KIND).selectExpr("*", "9 length", "9 n_docs")).first()
    assert (only["length"], only["n_docs"], only["truncated_total"]) == (0, 2, 0)


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    long = "<p>é" + "x" * 120 + "\r\n\r\nWARC/1.1 not a record\r\n\r\n</p>"
    rows = [(5, "http://a/5 b", long), (2, "http://a/2", long), (9, "u9", long), (3, "u3", "short"), (4, "u4", "short"), (6, None, None), (7, "u7", ""), (8, "u8", "y" * 100), (10, "u10", "y" * 100), (11, "u11", "y" * 99), (12, "u12", "y" * 99)]
    rows += [(100 + i, f"h{i}", f"<b>{i}</b>" * 40) for i in range(200)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' payload_digest", "1 first")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload]
        first = min(same)
        again = len(payload) >= 100 and i != first
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))


def test_archive_files_hold_the_payloads(spark, tmp_path):
    rows = [(1, "http://a", "p" * 150), (2, "http://b", "p" * 150)]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert bytes(got[1]["payload"]) == b"p" * 150 and got[2]["payload"] is None and got[2]["url"] == "http://b"
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def record(kind, i, payload):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    digest = hashlib.sha256(payload).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives_with_a_member_per_record(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record("warcinfo" if i == 0 else "response", i, b"payload %d" % i)) for i in range(6)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(i, b"payload %d" % i) for i in range(1, 6)]
    cut = gzip.compress(b"x" * 100)[:-9]
    with pytest.raises(ValueError):
        list(warc.members(cut))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BANDS", ((1000, 50), (10_000, 5), (50_000, 1)))
    rows = [(i, "u", f"{i:04}" * 100) for i in range(120)] + [(1000 + i, "u", f"{i:04}" * 2000) for i in range(12)] + [(2000 + i, "u", f"{i:04}" * 20_000) for i in range(3)]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    sizes = [[len(b) for _, b in warc.parse_warc(gzip.decompress(f.read_bytes()))] for f in (tmp_path / "w").glob("*.gz") if gzip.decompress(f.read_bytes())]
    assert all(sum(s) < 60_000 or len(s) == 1 for s in sizes)
    assert sorted(r["page_id"] for r in warc.read_warc(spark, f"{tmp_path}/w").collect()) == [r[0] for r in rows]


def test_revisits_name_the_url_of_the_response(spark, tmp_path):
    rows = [(2, "http://first", "p" * 150), (7, "http://again", "p" * 150), (None, "http://none", "p" * 150)]
    got = warc.warc_records(spark.createDataFrame(rows, PAGES)).collect()
    again = [r["record"] for r in got if "WARC-Type: revisit" in r["record"]]
    assert len(again) == 2 and all("WARC-Refers-To: <urn:page:2>\r\nWARC-Refers-To-Target-URI: http://first\r\n" in r for r in again)


def test_archive_edge_cases(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "u", "z" * 100), (1, "u", "z" * 100), (None, "u", "z" * 100)]
    got = sorted((r["record_type"], r["page_id"] or 0, r["refers_to"] or 0) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [("response", 1, 0), ("response", 1, 0), ("revisit", 0, 1)]


def brute_shards(keys, shards):
    """Keys walk the ring one by one, part by part of each arc; those that find no room wait for the next arc with room.

    ``keys``: {id: the other columns that tell rows apart}.
    """
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    nodes = sorted((int(md5(f"shard-{s}-node-{v}")[:8], 16), s) for s in range(shards) for v in range(64))
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    place = {i: int(md5(str(i))[:8], 16) for i in keys}
    part = {i: int(md5("|".join(map(str, (i, *tie))))[8:12], 16) % 16 for i, tie in keys.items()}
    units = {}
    for i in sorted(keys, key=lambda i: (place[i], i)):
        arc = next((k for k, (p, _) in enumerate(nodes) if p >= place[i]), 0)
        units.setdefault((arc, part[i]), []).append(i)
    out, waiting = {}, []
    for turn in range(2):
        for arc, (_, s) in enumerate(nodes):
            for k in range(16):
                own = units.get((arc, k), []) if turn == 0 else []
                took = own[: room[s]]
                room[s] -= len(took)
                drained, waiting = waiting[: room[s]], waiting[room[s] :]
                room[s] -= len(drained)
                out |= dict.fromkeys(took + drained, s)
                waiting += own[len(took) :]
    return out


def test_shards_match_a_walk_and_are_even(spark):
    rows = [(i * 3, f"text {i % 7}" if i % 11 else None) for i in range(1003)]
    got = sharding.shard_documents(spark.createDataFrame(rows, KIND).selectExpr("*", "1 shard", "'s' slot", "2 size")).collect()
    ties = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {r["doc_id"]: r["shard"] for r in got} == brute_shards(ties, 8)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sorted(counts) == list(range(8))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    texts = dict(rows)
    for r in got:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "rows", None)


def test_one_more_shard_moves_few_keys(spark):
    ids = spark.range(4000).selectExpr("id AS doc_id")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(ids, n).collect()} for n in (8, 9))
    strict = sum(before[i] != after[i] for i in before)
    assert strict < 0.2 * len(before)
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(ids, n, slack=0.5).collect()} for n in (8, 9))
    assert sum(before[i] != after[i] for i in before) <= min(strict, 0.13 * len(before))
    assert max(Counter(after.values()).values()) <= 4000 * 1.5 / 9 + 1


@pytest.mark.parametrize("shards", [1, 2, 512, 2048])
def test_no_row_is_lost_with_any_number_of_shards(spark, shards):
    got = sharding.assign_shards(spark.range(4096).selectExpr("id AS doc_id"), shards).collect()
    counts = Counter(r["shard"] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got) == 4096
    assert len(counts) == shards and max(counts.values()) - min(counts.values()) <= 1


def test_rows_of_one_key_are_spread_over_parts(spark):
    got = sharding.assign_shards(spark.range(900).selectExpr("1 AS doc_id", "id AS other"), 8, tie=("other",)).collect()
    assert len({r["other"] for r in got}) == 900 and set(Counter(r["shard"] for r in got).values()) <= {112, 113}


def test_plan_places_all_rows_or_fails():
    with pytest.raises(AssertionError):
        sharding.plan({0: 5}, [0], [4])


def test_shard_edge_cases(spark):
    assert sharding.shard_documents(spark.createDataFrame([], KIND)).count() == 0
    got = sharding.shard_documents(spark.createDataFrame([(1, "a")] * 9 + [(None, None)], KIND)).collect()
    assert len(got) == 10 and max(Counter(r["shard"] for r in got).values()) == 2


def foreign(kind, name, payload, digest=None, content="application/http; msgtype=response", http="HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", version="1.0"):
    block = http.encode() + payload
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: http://x/{name}\r\nContent-Type: {content}\r\n"
    head += f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
    return head.encode() + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)


def test_foreign_digests_and_plain_archives(spark, tmp_path):
    import base64

    body = b"<p>payload</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        foreign("warcinfo", "0", b"", content="application/warc-fields", http=""),
        foreign("response", "1", body, sha1),
        foreign("response", "2", body, "SHA-256:" + hashlib.sha256(body).hexdigest().upper()),
        foreign("response", "3", body, "blake3:0000"),
        foreign("response", "4", b"7\r\npayload\r\n0\r\n\r\n", sha1, http="HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"),
        foreign("response", "5", b"20240101 1.2.3.4", content="text/dns", http=""),
        foreign("revisit", "6", b"", sha1, http="HTTP/1.1 200 OK\r\nContent-Length: 14\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[4:])))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r["url"][-1]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert sorted(got) == list("123456")
    assert all(bytes(got[k]["payload"]) == body and got[k]["payload_digest"] == hashlib.sha256(body).hexdigest() for k in "123")
    assert bytes(got["5"]["payload"]) == b"20240101 1.2.3.4"
    assert (got["6"]["payload_bytes"], got["6"]["payload_digest"], got["6"]["payload"]) == (14, sha1, None)
    with pytest.raises(ValueError):
        warc._row({"warc-type": "response", "warc-record-id": "x", "warc-payload-digest": sha1}, b"HTTP/1.1 200 OK\r\n\r\nother")
    assert warc.stated_digest("md5:zz") == warc.stated_digest("sha1:abc") == warc.stated_digest(None) == (None, None)
    assert warc.stated_digest("sha1:" + hashlib.sha1(body).hexdigest()) == ("sha1", hashlib.sha1(body).digest())


def test_a_very_long_page_and_a_date(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 400_000), (2, "u", "é" * 400_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert got[1]["payload_bytes"] == 800_000 and got[2]["refers_to"] == 1
    assert all("WARC-Date: 2025-02-03T04:05:06Z" in r["record"] for r in warc.warc_records(pages, "2025-02-03T04:05:06Z").collect())
