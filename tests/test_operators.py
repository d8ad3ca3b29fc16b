import hashlib
import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import dedup, delivery, feed, fold, normalize, resolve, validate

T = datetime(2026, 1, 10, 12)
EVIDENCE = "evidence_id long, provider string, provider_item_id string, provider_item_hash string, official_source boolean, canonical_url string, title string, event_time timestamp, observed_at timestamp, entity_refs array<string>"


def evidence(spark, *rows):
    base = dict(evidence_id=1, provider="marketaux", provider_item_id=None, provider_item_hash="h", official_source=False, canonical_url=None, title=None, event_time=T, observed_at=T, entity_refs=[])
    rows = [base | r for r in rows]
    return resolve.with_signatures(spark.createDataFrame([tuple(r.values()) for r in rows], EVIDENCE))


def candidate(spark, *rows):
    schema = "id long, identity_signatures array<string>, title_fingerprints array<string>, first_seen_at timestamp, latest_seen_at timestamp, entities array<string>"
    base = dict(id=1, identity_signatures=[], title_fingerprints=[], first_seen_at=T, latest_seen_at=T, entities=[])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def decide(rows, candidates):
    r = resolve.match(rows, candidates).first()
    return r.matched_candidate_id, r.match_rule, r.anchor_type


def test_url_matches_across_spellings(spark):
    old = evidence(spark, dict(canonical_url="https://example.test/news")).first()
    new = evidence(spark, dict(provider="eia", canonical_url="https://EXAMPLE.test:443/news/?utm_source=one"))
    assert decide(new, candidate(spark, dict(id=7, identity_signatures=old.signatures))) == (7, "canonical_url", "url")
    other = evidence(spark, dict(provider="eia", canonical_url="https://example.test/news?id=200"))
    assert decide(other, candidate(spark, dict(id=7, identity_signatures=old.signatures)))[:2] == (None, "new_candidate")


def test_tie_is_ambiguous(spark):
    row = evidence(spark, dict(provider_item_id="p"))
    s = row.first().signatures
    assert decide(row, candidate(spark, dict(id=1, identity_signatures=s), dict(id=2, identity_signatures=s))) == (None, "ambiguous_new_candidate", "ambiguous_evidence")


def test_official_outranks_and_needs_both(spark):
    official = evidence(spark, dict(provider_item_id="p", official_source=True))
    assert decide(official, candidate(spark, dict(id=3, identity_signatures=official.first().signatures)))[1] == "official_identity"
    plain = evidence(spark, dict(provider_item_id="p"))
    assert decide(plain, candidate(spark, dict(id=3, identity_signatures=official.first().signatures)))[1] == "provider_external_id"


@pytest.mark.parametrize(("shift", "rule"), [(timedelta(hours=24), "entity_title_time"), (timedelta(hours=-24), "entity_title_time"), (timedelta(hours=24, seconds=1), "new_candidate"), (timedelta(days=3), "new_candidate")])
def test_time_window_is_closed(spark, shift, rule):
    row = evidence(spark, dict(title="Same Title", entity_refs=["a", "b"], event_time=T + shift))
    fp = row.first().title_fingerprint
    assert decide(row, candidate(spark, dict(title_fingerprints=[fp], entities=["b"])))[1] == rule


def test_shared_company_alone_does_not_merge(spark):
    assert decide(evidence(spark, dict(title="One", entity_refs=["a"])), candidate(spark, dict(entities=["a"], title_fingerprints=["x"])))[1] == "new_candidate"


def test_hash_is_scoped_by_provider(spark):
    s = evidence(spark, {}).first().signatures
    assert decide(evidence(spark, dict(provider="eia")), candidate(spark, dict(identity_signatures=s)))[1] == "new_candidate"


def test_bucket_before_1970_rounds_down(spark):
    early = evidence(spark, dict(title="x", entity_refs=["a"], event_time=datetime(1969, 12, 31, 23)), dict(evidence_id=2, title="x", entity_refs=["a"], event_time=datetime(1970, 1, 1, 1)))
    assert len({r.cluster_key for r in resolve.with_anchor(early).collect()}) == 2


def plain_fold(rows):
    """The sequential process in plain Python, over all candidates at once."""
    clusters, out = [], {}
    for r in sorted(rows, key=lambda r: (r.event_time or r.observed_at, r.evidence_id)):
        at, ranked = r.event_time or r.observed_at, []
        for c in clusters:
            kinds = {s.split(":")[0] for s in set(r.signatures) & c["sigs"]}
            if "official" in kinds or "url" in kinds or "provider" in kinds:
                ranked.append((1 if "official" in kinds else 2 if "url" in kinds else 3, c))
            elif r.title_fingerprint and r.title_fingerprint in c["fps"] and set(r.entity_refs) & c["ents"] and c["first"] - timedelta(days=1) <= at <= c["last"] + timedelta(days=1):
                ranked.append((4, c))
            elif kinds:
                ranked.append((5, c))
        best = [c for k, c in ranked if k == min(x for x, _ in ranked)]
        key = None
        if len(best) == 1:
            c = best[0]
        else:
            key = r.lone_key if best else r.cluster_key
            c = next((c for c in clusters if c["key"] == key), None)
            if c is None:
                c = dict(key=key, sigs=set(), fps=set(), ents=set(), first=at, last=at)
                clusters.append(c)
        c["sigs"] |= set(r.signatures)
        c["fps"] |= {r.title_fingerprint} - {None}
        c["ents"] |= set(r.entity_refs)
        c["first"], c["last"] = min(c["first"], at), max(c["last"], at)
        out[r.evidence_id] = c["key"]
    return out


def keyed_rows(df):
    return resolve.with_anchor(df).join(resolve.with_anchor(df, F.lit(True)).select("evidence_id", F.col("cluster_key").alias("lone_key")), "evidence_id").collect()


@pytest.mark.parametrize(("seed", "n", "hours"), [(5, 60, 200), (6, 90, 60)])
def test_fold_equals_the_sequential_process(spark, seed, n, hours, monkeypatch):
    import random

    monkeypatch.setattr(fold, "BUCKET_BITS", 3)  # several buckets a key
    rng = random.Random(seed)
    rows = [dict(evidence_id=i, provider=rng.choice(["marketaux", "eia"]), provider_item_id=rng.choice([None, None, *"abcdefgh"]), provider_item_hash=f"h{rng.randint(0, n // 2)}", official_source=rng.random() < 0.3, canonical_url=rng.choice([None, None, None, f"https://t.test/{rng.randint(0, n // 3)}"]), title=rng.choice([None, "One", "Two", "Three", "Four"]), event_time=T + timedelta(hours=rng.randint(0, hours)), entity_refs=rng.sample("pqrst", rng.randint(0, 3))) for i in range(n)]
    df = evidence(spark, *rows)
    want = plain_fold(keyed_rows(df))
    got = {r.evidence_id: (r.cluster_key, r.match_rule) for r in fold.fold(df).collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert len({r for _, r in got.values()}) >= 4


def test_fold_of_one_chain_takes_few_rounds(spark, monkeypatch):
    """Rows that all share one address, and then rows of one title an hour apart: no round for each of them."""
    rows = [dict(evidence_id=i, provider_item_hash=f"a{i}", provider_item_id=f"x{i}", canonical_url="https://t.test/1") for i in range(40)] + [dict(evidence_id=100 + i, provider_item_hash=f"b{i}", provider_item_id=f"y{i}", title="Long story", entity_refs=["p"], event_time=T + timedelta(hours=i)) for i in range(120)]
    rounds, decided = [], fold._decided
    monkeypatch.setattr(fold, "_decided", lambda *a: rounds.append(1) or decided(*a))
    got = {r.evidence_id: r.cluster_key for r in fold.fold(evidence(spark, *rows)).collect()}
    assert len({v for k, v in got.items() if k < 100}) == 1 and len({v for k, v in got.items() if k >= 100}) == 1 and len(rounds) == 1
    assert fold.fold(evidence(spark).limit(0)).collect() == []


def test_filings_cut_and_padded(spark):
    body = '{"filings":{"recent":{"accessionNumber":["a","b","c"],"filingDate":["2026-01-01","2026-01-02"],"acceptanceDateTime":["2026-01-01T10:00:00Z","x"],"reportDate":["2025-12-31","2025-12-30"],"form":["8-K","10-Q"],"primaryDocument":["d",""]}}}'
    df = spark.createDataFrame([(body, "T")], "body string, ticker string")
    cut = normalize.filing_rows(df)
    assert cut.count() == 2 and normalize.filing_rows(df, padded=True).count() == 3
    rows = normalize.filing_evidence(cut, F.lit(T)).orderBy("event_time").collect()
    assert [(str(r.event_time), r.content_presence.has_url, r.processing_status) for r in rows] == [("2026-01-01 10:00:00", True, "validated"), ("2026-01-02 00:00:00", False, "validated")]


def test_mappers_make_valid_envelopes(spark):
    news = spark.createDataFrame([('{"data":[{"uuid":"u","title":"t","url":"https://x.test","published_at":"2026-01-01T00:00:00Z","entities":["e",""],"keywords":null},{"title":"no id","published_at":"2026-01-01T00:00:00Z"}]}',)], "body string")
    rows = normalize.news_evidence(normalize.news_rows(news), F.lit(T))
    assert [(r.processing_status, len(r.entity_refs), len(r.errors)) for r in rows.collect()] == [("validated", 1, 0), ("blocked", 0, 1)]
    quotes = spark.createDataFrame([('{"c":1.5,"d":2,"dp":"x","h":true,"t":1700000000}', "S")], "body string, symbol string")
    quote = normalize.quote_evidence(normalize.quote_rows(quotes), F.lit(T))
    assert (quote.first().numeric_presence.numeric_field_count, str(quote.first().event_time)) == (2, "2023-11-14 22:13:20")
    energy = spark.createDataFrame([('{"response":{"data":[{"period":"2026-01","price":"1.5","stateid":"","stateDescription":"Texas","sectorid":"RES"}]}}',)], "body string")
    power = normalize.energy_evidence(normalize.energy_rows(energy), F.lit(T))
    assert normalize.energy_rows(energy).first().item_id == "2026-01:Texas:RES"
    for df in (rows, quote, power):
        assert all(list(r.e) == [] for r in df.select(validate.envelope_errors().alias("e")).collect())


def test_classify_null_ids_never_match(spark):
    schema = "id long, provider string, provider_item_id string, provider_item_hash string, source_id string, source_account_id string, raw_item_id long, content_item_id long, event_time timestamp, processing_status string, official_source_flag boolean"
    row = lambda i, item, h, raw=1: (i, "p", item, h, "s", None, raw, None, T, "validated", False)
    rest = {c: F.lit("same") for c in dedup.EQUIVALENCE if f"{c} " not in schema}
    whole = lambda rows: spark.createDataFrame(rows, schema).withColumns(rest)
    stored = whole([row(1, None, "a"), row(2, "x", "b")])
    assert dedup.classify(stored.withColumn("access_level", F.lit("other")), stored).select("decision").distinct().collect() == [("provider_hash_conflict",)]
    incoming = whole([row(10, None, "a"), row(11, None, "c"), row(12, "x", "d"), row(13, "x", "b", 5)])
    assert {r.id: r.decision for r in dedup.classify(incoming, stored).collect()} == {10: "existing", 11: "inserted", 12: "provider_item_id_conflict", 13: "provider_hash_conflict"}


def test_claims(spark):
    schema = "id long, status string, retry_count int, scheduled_at timestamp, failure_code string"
    rows = [(1, "pending", 0, None, None), (2, "failed", 2, T, "x"), (3, "failed", 3, T, "x"), (4, "sending", 1, T - timedelta(seconds=301), None), (5, "sending", 1, T - timedelta(seconds=300), None), (6, "sent", 0, T, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.status, r.retry_count) for r in delivery.claim_retries(df, F.lit(T), limit=9).collect()}
    assert got == {1: ("sending", 0), 2: ("sending", 3), 4: ("sending", 2)}
    assert delivery.exhausted(df, F.lit(T)).first().exhausted == 1


def test_feed_limits_and_messages(spark):
    with pytest.raises(ValueError):
        feed.recent(None, None, None, limit=51)
    items = spark.createDataFrame([(1, 1, "x" * 3000), (1, 2, "y" * 3000), (2, 1, "z")], "k long, o long, block string")
    assert {r.k: r.message_error for r in feed.messages(items, "k", "o").collect()} == {1: "message_too_long", 2: None}


def test_closed_projection(spark):
    keys = list(validate.PROJECTION_KEYS["eia"])
    rows = [("eia", keys), ("eia", keys[:-1]), ("eia", [*keys, "more"]), ("odd", keys)]
    df = spark.createDataFrame(rows, "p string, k array<string>")
    assert [r.e for r in df.select(validate.projection_error(F.col("p"), F.col("k")).alias("e")).collect()] == [None, "projection_keys_mismatch", "projection_keys_mismatch", "unknown_provider"]


def test_sidecar_binds_nulls_and_last_wins(spark):
    raw = spark.createDataFrame([(1, None, "h", "l"), (2, "x", "h", "l")], "id long, external_id string, payload_hash string, payload_location string")
    pending = spark.createDataFrame([(None, "h", "l", 1, "old"), (None, "h", "l", 2, "new")], "external_id string, payload_hash string, payload_location string, seq int, meta string")
    assert {r.id: r.meta for r in normalize.bound_sidecar(raw, pending).collect()} == {1: "new", 2: None}


def test_matches_of_one_title_grow_with_the_rows(spark):
    """Every row shares title and entity: evidence times candidates would be 4 million rows."""
    n = 2000
    at = lambda c: F.expr(f"timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast({c} % 50 as int), 0, 0)")
    e = spark.range(n).select(F.col("id").alias("evidence_id"), F.lit("t").alias("title_fingerprint"), at("id").alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("observed_at"), F.array(F.lit("e")).alias("entity_refs"), F.array(F.lit("url:x")).alias("signatures"))
    c = spark.range(n).select("id", at("id").alias("first_seen_at"), at("id").alias("latest_seen_at"), F.array(F.lit("e")).alias("entities"), F.array(F.lit("t")).alias("title_fingerprints"), F.array(F.lit("url:x")).alias("identity_signatures"))
    got = {}
    for r in resolve.time_window_matches(e, c).collect():
        got.setdefault(r.evidence_id, set()).add(r.candidate_id)
    near = lambda i: [k for k in range(n) if abs(i % 50 - k % 50) <= 24]
    assert all(got[i] == {near(i)[0], near(i)[-1]} for i in range(0, n, 97)) and sum(map(len, got.values())) <= 2 * n
    counts = {r.evidence_id: r.matches for r in resolve.time_window_counts(e, c).collect()}
    assert all(counts[i] == len(near(i)) for i in range(n))
    assert resolve.signature_matches(e, c).count() == 2 * n


def test_whole_envelope_fits_the_declared_table(spark):
    from siltstone.schemas import TABLES

    df = spark.createDataFrame([("{}", "S")], "body string, symbol string")
    made = dict(normalize.quote_evidence(normalize.quote_rows(df), F.lit(T)).dtypes)
    wanted = dict(spark.createDataFrame([], TABLES["evidence_items"]).dtypes)
    assert {c: made[c] for c in made} == {c: wanted[c] for c in made}


def test_provider_outcome_and_news_item(spark):
    from siltstone.operators import schedule

    rows = [(True, 0, 0, "succeeded", None), (True, 2, 2, "succeeded", []), (True, 0, 0, "failed", None), (True, 2, 0, "succeeded", None), (True, 0, 0, "succeeded", ["x"]), (None, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "p boolean, raw long, ev long, c string, e array<string>")
    got = [tuple(r.o) for r in df.select(schedule.provider_outcome(*(F.col(x) for x in ("p", "raw", "ev", "c", "e"))).alias("o")).collect()]
    assert got == [("PASS", True), ("PASS", False), ("FAIL", False), ("FAIL", False), ("FAIL", False), ("FAIL", False)]
    news = spark.createDataFrame([("u", "t", "x" * 2001, "https://a.test/"), ("u", "t", " ok  title", "https://u@a.test/"), ("my token", "t", "password=1", None)], "uuid string, published_at string, title string, url string")
    got = [(r.title, r.has_title, r.has_url, r.is_valid) for r in validate.news_item(news.withColumns({"description": F.lit(""), "snippet": F.lit("s")})).collect()]
    assert got == [(None, False, True, True), ("ok title", True, False, True), (None, False, False, False)]


def test_projection_rules_one_by_one(spark):
    from siltstone.operators import projections

    good = {"provider_item_id": "i", "published_at": "2024-01-05", "field_names": [], "payload_hash": "a" * 64, "payload_reference": "capture://x", "symbol": "S", "numeric_field_count": 7}
    change = lambda **more: json.dumps(good | more)
    cases = [
        (json.dumps(good), None), (change(numeric_field_count=True), None), (change(numeric_field_count=-1), None), (change(numeric_field_count=8), "provider_fields_invalid"), (change(numeric_field_count="1"), "provider_fields_invalid"),
        (change(symbol=""), "provider_fields_invalid"), (change(provider_item_id=None), "projection_identity_invalid"), (change(published_at="my secret"), "projection_identity_invalid"), (change(field_names=[1]), "field_names_invalid"),
        (change(field_names=["x", ""]), "field_names_invalid"), (change(field_names=[None]), "field_names_invalid"), (change(field_names=None), "field_names_invalid"), (change(payload_hash="A" * 64), "payload_hash_invalid"), (change(payload_hash="a" * 64 + "\n"), "payload_hash_invalid"),
        (change(payload_reference="capture://token"), "payload_reference_invalid"), (change(payload_reference=1), "payload_reference_invalid"), (change(more=1), "projection_keys_mismatch"), ("[]", "projection_keys_mismatch"), ("no json", "projection_keys_mismatch"), (None, "projection_keys_mismatch"),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i long, p string").repartition(2)
    got = {r.i: r.e for r in df.select("i", projections.content_error(F.lit("finnhub"), F.col("p")).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    rows = df.select(F.lit("finnhub").alias("provider"), F.col("p").alias("projection"), F.lit(T).alias("observed_at"))
    out = projections.projection_evidence(rows).collect()
    assert sorted(r.numeric_presence.numeric_field_count for r in out) == [0, 1, 7] and {r.processing_status for r in out} == {"validated"}
    item = {k: 0 for k in ("c", "d", "dp", "h", "l", "o", "pc")} | {"published_at": "2024-01-05", "t": "2024-01-05"}
    assert hashlib.sha256(json.dumps(item, sort_keys=True, separators=(",", ":")).encode()).hexdigest() in {r.provider_item_hash for r in out}
    assert projections.projection_evidence(rows.limit(0)).count() == 0


def test_nested_payloads(spark):
    from siltstone.operators import payloads

    deep = "[" * 100_000 + "]" * 100_000
    rows = [("marketaux", '{"data":[1,{"TOKEN":"a","b":["api_key=1","ok"]},3],"u":"é TOKEN=x"}'), ("sec_edgar", '{"filings":{"recent":{"form":["a","b","c"],"n":1}}}'), ("eia", '{"response":{"data":[1,2,3]},"data":[1,2,3]}'),
            ("finnhub", '{"c":NaN}'), (None, "no json"), ("eia", None), ("eia", deep), ("marketaux", '"a token=1"'), ("marketaux", '{"data":{"x":[1,2,3]}}'), ("marketaux", '[{"data":[1,2,3]}]'), ("marketaux", '{"data":[[1,2,3],{"token":1},"token=",4,5]}')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, p string, b string").withColumn("risk", F.lit("clash")).repartition(3)
    made = payloads.with_secret_flag(payloads.shortened(payloads.redacted(df, "b", "r"), "b", "s", 2, provider="p"), "b", "risk")
    assert made.limit(0).count() == 0 and payloads.redacted(df.where("false"), "b", "r").count() == 0
    got = sorted(made.select("i", "r", "s", "risk").collect())
    none = (None, None, None)
    assert [tuple(r)[1:] for r in got] == [
        ('{"data":[1,{"TOKEN":"[REDACTED]","b":["api_key=1","ok"]},3],"u":"\\u00e9 TOKEN=x"}', '{"data":[1,{"b":["ok"]}]}', True), (rows[1][1], '{"filings":{"recent":{"form":["a","b"],"n":1}}}', False),
        (rows[2][1], '{"response":{"data":[1,2]},"data":[1,2,3]}', False), none, none, none, (deep, deep, False), ('"a token=1"', '"a token=1"', True), (rows[8][1], rows[8][1], False), (rows[9][1], rows[9][1], False),
        ('{"data":[[1,2,3],{"token":"[REDACTED]"},"token=",4,5]}', '{"data":[[1,2,3],{}]}', True),
    ]


json_values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(10**25), 10**25), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6)), lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(st.text(max_size=4), v, max_size=4)), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(json_values, st.sampled_from([None, 1]), st.booleans(), st.integers(0, 10**6), st.sampled_from(",[]{}:\"0-.et "))
def test_canonical_json_is_pythons(value, indent, plain, place, noise):
    """Byte for byte the sorted compact form; what Python can't read is refused, and nothing else."""
    from siltstone.functions import json_text

    said = json.dumps(value, indent=indent, ensure_ascii=plain)
    assert json_text.canonical(said) == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert json_text.rewritten(said) == json.dumps(value, separators=(",", ":"))
    odd = said[: place % len(said)] + noise + said[place % len(said) :]

    def refuse(constant):
        raise ValueError(constant)

    try:
        want = json.dumps(json.loads(odd, parse_constant=refuse), sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        want = None
    try:
        got = json_text.canonical(odd)
    except ValueError:
        got = None
    assert got == want


def test_merged_summaries_without_rows_or_maps(spark):
    from siltstone.operators import coverage

    schema = "counts map<string,long>, nested map<string,map<string,long>>"
    assert [tuple(r) for r in coverage.merged(spark.createDataFrame([], schema)).collect()] == [("captures_seen", None, 0)]
    rows = [({"items": 2, "odd": None}, {"t": {"a": 1}}), (None, None), ({"items": 3}, {"t": {"a": 4, "b": 1}, "u": None})]
    got = {(r["name"], r["key"]): r["n"] for r in coverage.merged(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("items", None): 5, ("odd", None): 0, ("t", "a"): 5, ("t", "b"): 1, ("captures_seen", None): 3}


def test_time_windows_equal_brute_force(spark):
    """Several entities shared by one candidate count once; nulls match nothing; ends are included."""
    import random

    rng = random.Random(9)
    rows = [dict(evidence_id=i, title=rng.choice([None, "One", "Two"]), entity_refs=rng.sample("pqrs", rng.randint(0, 3)), event_time=T + timedelta(hours=rng.randint(0, 150))) for i in range(80)]
    e = evidence(spark, *rows)
    fps = sorted({r.title_fingerprint for r in e.collect() if r.title_fingerprint})
    cands = [dict(id=k, title_fingerprints=rng.sample(fps, rng.randint(0, 2)), entities=rng.sample("pqrs", rng.randint(0, 4)), first_seen_at=T + timedelta(hours=(h := rng.randint(0, 150))), latest_seen_at=T + timedelta(hours=h + rng.choice([0, 1, 30, 90]))) for k in range(60)]
    c = candidate(spark, *cands)
    day = timedelta(days=1)
    want = {(r.evidence_id, k["id"]) for r in e.collect() for k in cands if r.title_fingerprint in k["title_fingerprints"] and set(r.entity_refs) & set(k["entities"]) and k["first_seen_at"] - day <= r.event_time <= k["latest_seen_at"] + day}
    assert {(r.evidence_id, r.candidate_id) for r in resolve.time_window_pairs(e, c).collect()} == want
    counts = {}
    for i, _ in want:
        counts[i] = counts.get(i, 0) + 1
    assert {r.evidence_id: r.matches for r in resolve.time_window_counts(e, c).collect()} == counts
    two = {}
    for r in resolve.time_window_matches(e, c).collect():
        two.setdefault(r.evidence_id, set()).add(r.candidate_id)
    assert two == {i: {min(k for j, k in want if j == i), max(k for j, k in want if j == i)} for i in counts}


def test_time_window_pairs_are_not_shuffled(spark):
    """Pairs of ids that one row has come out of the join as they are; others, nulls too, come out once."""
    t = lambda **more: dict(title="One", entity_refs=["p", "q"], event_time=T) | more
    e = evidence(spark, t(evidence_id=1), t(evidence_id=2, event_time=T + timedelta(hours=5)))
    fp = e.first().title_fingerprint
    c = lambda k, **more: dict(id=k, title_fingerprints=[fp], entities=["p", "q"], first_seen_at=T, latest_seen_at=T + timedelta(days=2)) | more
    pairs = resolve.time_window_pairs(e, candidate(spark, c(7), c(8)))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 7, 4), (1, 8, 4), (2, 7, 4), (2, 8, 4)]
    twice = e.union(evidence(spark, t(evidence_id=1, event_time=T + timedelta(days=1)))).union(e.where("evidence_id = 2").withColumn("evidence_id", F.lit(None).cast("long"))).union(e.where("evidence_id = 1").withColumn("evidence_id", F.lit(None).cast("long")))
    again = candidate(spark, c(7), c(7, entities=["p"]), c(7), c(8))
    got = [tuple(r) for r in resolve.time_window_pairs(twice, again).collect()]
    assert sorted(got, key=str) == sorted(((i, k, 4) for i in (1, 2, None) for k in (7, 8)), key=str)


def test_time_window_pairs_of_a_large_class_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "_BLOCK", 16)
    e = spark.range(100).select(F.col("id").alias("evidence_id"), F.lit("t").alias("title_fingerprint"), F.lit(T).cast("timestamp_ntz").alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("observed_at"), F.array(F.lit("e")).alias("entity_refs"))
    c = spark.range(60).select("id", F.lit(T).cast("timestamp_ntz").alias("first_seen_at"), F.lit(T).cast("timestamp_ntz").alias("latest_seen_at"), F.array(F.lit("e")).alias("entities"), F.array(F.lit("t")).alias("title_fingerprints"))
    rows = resolve.time_window_pairs(e, c).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.evidence_id, r.candidate_id) for r in rows) == [(i, k) for i in range(100) for k in range(60)]
    assert len({r.task for r in rows}) > 10


def test_projections_are_parsed_once_in_one_scan(spark, sf_dir):
    from siltstone.operators import projections
    from siltstone.plans import more

    rows = more._projections(spark, sf_dir)
    plan = projections.projection_evidence(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("parseJson") == 1
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


LINKS = "candidate_id long, evidence_id long, source_id string, official boolean, entity string, active boolean, removed_at timestamp"


def test_rollups_by_deltas_equal_recomputation(spark):
    """Random closings, moves and new links: what the changes make of the roll-up is what all links give."""
    import random

    from siltstone.operators import rollup

    rng = random.Random(11)
    new = lambda c, e: (c, e, f"s{e % 4}", e % 5 == 0, rng.choice([None, "x", "y", f"z{e}"]), True, None)
    rows = [new(rng.randint(0, 6), e) for e in range(40)]
    links = spark.createDataFrame(rows, LINKS)
    counts, state = rollup.active_counts(links), rollup.multiplicities(links)
    for step in range(3):
        held = [r for r in links.collect() if r.active]
        off = [(r.candidate_id, r.evidence_id) for r in held if r.candidate_id == step or rng.random() < 0.2]
        moved = [(r.evidence_id, r.candidate_id, 10 + step) for r in held if (r.candidate_id, r.evidence_id) not in off and rng.random() < 0.2]
        which = spark.createDataFrame(off, "candidate_id long, evidence_id long")
        moves = spark.createDataFrame(moved, "evidence_id long, from_id long, to_id long")
        after = rollup.regroup(rollup.deactivate(links, which, F.lit(T)), moves, F.lit(T)).drop("match_rule")
        after = after.unionByName(spark.createDataFrame([new(rng.randint(4, 8), 100 * (step + 1) + k) for k in range(5)], LINKS))
        after = spark.createDataFrame(after.collect(), LINKS)
        deltas = rollup.link_deltas(links, after)
        state = rollup.with_deltas(state, deltas)
        counts = rollup.refreshed(counts, state, deltas)
        counts, state = (spark.createDataFrame(df.collect(), df.schema) for df in (counts, state))
        cols = ("candidate_id", "evidence_count", "source_count", "official", "entity_count")
        as_set = lambda df: {tuple(r[c] for c in cols) for r in df.collect()}
        assert as_set(counts) == as_set(rollup.active_counts(after))
        assert as_set(rollup.counts_of(state)) == {r for r in as_set(counts) if r[1]}
        assert not after.where("active = (removed_at is not null)").count()
        links = after


def test_claims_of_a_channel_are_bounded_before_the_exchange(spark):
    rows = spark.range(5000).select("id", F.lit("failed").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("scheduled_at"), F.lit(None).cast("string").alias("failure_code"), F.lit("telegram").alias("channel"), F.when(F.col("id") < 4990, "a").otherwise("b").alias("policy_rule_id"))
    limits = spark.createDataFrame([("telegram", "a", 3), ("telegram", "b", 50), ("mail", "a", 5)], "channel string, policy_rule_id string, claims int")
    got = delivery.claim_retries_by(rows, limits, F.lit(T), most=4)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 4990, 4991, 4992, 4993]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_a_message_is_delivered_as_a_whole(spark):
    rows = [(1, 0, "ok", False), (1, 1, "x" * 20, False), (2, 0, "ok", False), (2, 1, None, False), (3, 0, "ok", True), (3, 9, "beyond the limit", False), (4, 0, "y" * 31, None), (5, 0, "a", False), (6, 0, "b", False)]
    items = spark.createDataFrame(rows, "m long, o long, block string, unsafe boolean")
    answers = spark.createDataFrame([(1, 204, None), (5, 200, "socket"), (6, None, None)], "m long, http_status int, failure string")
    got = {(r.m, r.o): (r.status, r.failure_code) for r in delivery.deliver(items, answers, "m", "o", limit=2, message_chars=30).collect()}
    assert got == {(1, 0): ("sent", None), (1, 1): ("sent", None), (2, 0): ("failed", delivery.UNSUPPORTED), (2, 1): ("failed", delivery.UNSUPPORTED), (3, 0): ("failed", delivery.LEAKING), (3, 9): ("failed", delivery.LEAKING), (4, 0): ("failed", delivery.TOO_LONG), (5, 0): ("failed", delivery.FAILED), (6, 0): ("failed", delivery.REJECTED)}


def test_counts_go_through_one_exchange_of_links_and_deal_out_hot_candidates(spark, monkeypatch):
    """Links are not multiplied before they are dealt out; a candidate with more links than one task takes is dealt by values."""
    from siltstone.operators import rollup

    rows = [(i % 3 and i, i % 50, f"s{i % 7}", i % 9 == 0, None if i % 4 == 0 else f"x{i % 5}", i % 2 == 0, None) for i in range(300)]
    links = spark.createDataFrame(rows, LINKS)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    plain, state = as_set(rollup.active_counts(links)), as_set(rollup.multiplicities(links))
    plan = rollup.active_counts(links)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Expand" not in plan
    expected = {}
    for c, e, s, o, x, active, _ in rows:
        kinds = expected.setdefault(c, (set(), set(), set(), set()))
        if active:
            for k, v in zip(kinds, (e, s, o or None, x), strict=True):
                if v is not None:
                    k.add(v)
    assert plain == {(c, len(e), len(s), bool(o), len(x)) for c, (e, s, o, x) in expected.items()}
    monkeypatch.setattr(rollup, "TASK_ROWS", 20)
    assert as_set(rollup.active_counts(links)) == plain and as_set(rollup.multiplicities(links)) == state
    parts = rollup._by_value(links, "candidate_id", F.lit(1)).where("candidate_id = 0").select("part").distinct().count()
    assert parts > 10


def test_kept_up_counts_equal_recomputation(spark):
    """Values that begin or cease to count move the counts; a candidate without links any more stays with zeros."""
    from siltstone.operators import rollup

    row = lambda c, e, active=True, entity="x", official=False: (c, e, f"s{e % 2}", official, entity, active, None)
    before = spark.createDataFrame([row(1, 1), row(1, 2, official=True), row(1, 2, official=True), row(2, 3, official=True), row(3, 4, False)], LINKS)
    after = spark.createDataFrame([row(1, 1, False), row(1, 2, official=True), row(1, 2, False, official=True), row(2, 3, False, official=True), row(3, 4, False), row(9, 3)], LINKS)
    counts, state = rollup.kept_up(rollup.active_counts(before), rollup.multiplicities(before), rollup.link_deltas(before, after))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(counts) == as_set(rollup.active_counts(after)) and as_set(state) == as_set(rollup.multiplicities(after))
