"""Signature, parse and routing rules of webhook deliveries."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from revlens.operators import events as E

SECRET = "s3cret"


def payload(**over):
    p = {"action": "opened", "number": 7,
         "pull_request": {"number": 7, "title": "T", "state": "open", "html_url": "u",
                          "user": {"login": "dev", "id": 1},
                          "head": {"label": "o:f", "ref": "f", "sha": "ABCDEF1234"},
                          "base": {"label": "o:m", "ref": "main", "sha": "abcdef9999"}},
         "repository": {"id": 1, "name": "r", "full_name": "o/r", "html_url": "u", "owner": {"login": "o"}},
         "sender": {"login": "dev", "id": 1}}
    for path, v in over.items():
        node = p
        keys = path.split(".")
        for k in keys[:-1]:
            node = node[k]
        if v is KeyError:
            node.pop(keys[-1], None)
        else:
            node[keys[-1]] = v
    return json.dumps(p)


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def route_one(spark, body, event="pull_request", signature="auto", secret=SECRET):
    sig = sign(body) if signature == "auto" else signature
    df = spark.createDataFrame([("d1", event, sig, body)],
                               "delivery_id string, event_name string, signature string, body string")
    return E.route(df, secret).first()


@pytest.mark.parametrize("key", ["k", "x" * 64, "y" * 100, "ключ"])
def test_hmac_matches_python(spark, key):
    body = '{"a": "é"}'
    got = spark.range(1).select(E.hmac_sha256_hex(key, F.lit(body)).alias("h")).first().h
    assert got == hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_signature_failures(spark):
    body = payload()
    assert route_one(spark, body, signature=None).http_code == 401
    assert route_one(spark, body, signature="md5=abc").http_code == 401
    assert route_one(spark, body, signature=sign(body, "other")).http_code == 401
    assert route_one(spark, "", signature=sign("")).http_code == 400
    assert route_one(spark, body, secret=None).http_code == 500
    assert route_one(spark, body).status == "queued"


@pytest.mark.parametrize("action", ["closed", "labeled", "assigned", "edited"])
def test_non_reviewable_actions_ignored(spark, action):
    r = route_one(spark, payload(action=action))
    assert (r.status, r.http_code) == ("ignored", 200)


def test_routing_order(spark):
    assert route_one(spark, payload(), event="ping").status == "ok"
    assert route_one(spark, payload(), event=None).status == "ignored"
    assert route_one(spark, payload(), event="issues").status == "ignored"
    assert route_one(spark, "{bad").http_code == 400
    assert route_one(spark, "[1, 2]").http_code == 422
    assert route_one(spark, payload(**{"repository": KeyError})).http_code == 422
    assert route_one(spark, payload(**{"pull_request.draft": True})).reason == "draft PR"
    assert route_one(spark, payload(**{"pull_request.title": 5})).http_code == 422
    assert route_one(spark, payload(**{"pull_request.draft": "maybe"})).http_code == 422


def test_sha_rules_and_defaults(spark):
    r = route_one(spark, payload(**{"pull_request.head.sha": "abc"}))
    assert r.http_code == 422 and r.schema_error == "pull_request.head.sha"
    r = route_one(spark, payload(number="12"))
    assert r.status == "queued" and r.event.number == 12
    e = route_one(spark, payload()).event
    assert e.pull_request.head.sha == "abcdef1234"
    assert e.pull_request.draft is False and e.pull_request.additions == 0
    assert e.pull_request.user.type == "User" and e.repository.owner.id == 0
    assert e.repository.private is False and e.repository.default_branch == "main"


def test_pr_context(spark):
    body = payload(**{"pull_request.body": "  hello  "})
    df = spark.createDataFrame([("d1", "pull_request", sign(body), body)],
                               "delivery_id string, event_name string, signature string, body string")
    ctx = E.pr_context(E.route(df, SECRET))
    r = ctx.select("pr_body", E.log_extra(ctx).alias("x")).first()
    assert r.pr_body == "hello"
    assert r.x.head_sha == "abcdef1234"


@pytest.mark.parametrize("field,value", [
    ("number", 1.5), ("pull_request.draft", None), ("pull_request.draft", 2), ("pull_request.additions", None),
    ("sender.type", None), ("pull_request.body", 5), ("sender.type", 5)])
def test_payload_fields_of_the_wrong_type_are_422(spark, field, value):
    r = route_one(spark, payload(**{field: value}))
    assert (r.http_code, r.schema_error) == (422, field)


@pytest.mark.parametrize("field,value", [
    ("number", "12"), ("number", 3.0), ("pull_request.draft", 0), ("pull_request.draft", "off"),
    ("pull_request.body", None), ("pull_request.body", "text")])
def test_payload_fields_read_leniently(spark, field, value):
    assert route_one(spark, payload(**{field: value})).status == "queued"


def test_a_filter_on_parsed_fields_does_not_parse_again(spark):
    df = spark.createDataFrame([(1, "pull_request", "{}", "s")], "delivery_id long, event_name string, body string, signature string")
    queued = E.route(df, "secret").filter("status = 'queued'").select("delivery_id", "event.action")
    parsed = E.parse_event(df).filter("schema_ok").filter("event.action = 'opened'").select("delivery_id")
    for out in (queued, parsed):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
        assert out.collect() == []


def test_bodies_that_nearly_fill_the_cores_are_not_shuffled(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, "pull_request", "{}", "s") for i in range(2 * cores)],
                               "delivery_id long, event_name string, body string, signature string")
    full, one, moved = df.coalesce(max(1, cores - 1)), df.coalesce(1), f"Repartition {cores}, true"
    for out in (E.parse_event(full), E.route(full, "secret")):
        assert moved not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.filter("json_ok").count() == 2 * cores
    if cores > 3:
        assert moved in E.parse_event(one)._jdf.queryExecution().optimizedPlan().toString()


def test_flow_parses_what_may_be_queued_and_spreads_its_files(spark, tmp_path, monkeypatch):
    from revlens.plans import review_flow as RF

    good = payload()
    rows = [(1, "pull_request", good, True, 1), (2, "pull_request", good, False, 2), (3, "ping", good, True, 3), (4, None, good, True, 4),
            (5, "pull_request", "{bad", True, 5), (6, "pull_request", payload(**{"pull_request.title": "T2"}), True, 6),
            (7, "issues", None, True, 7), (8, "pull_request", None, True, 8)]
    signed = [(i, ev, body, "sha256=" + hmac.new((SECRET if ok else "x").encode(), (body or "").encode(), hashlib.sha256).hexdigest(), h)
              for i, ev, body, ok, h in rows]
    df = (spark.createDataFrame(signed, "delivery_id long, event_name string, body string, signature string, h int")
          .selectExpr("delivery_id", "event_name", "body", "signature", "timestamp_seconds(h) AS received_ts"))
    parsed, parse = spark.sparkContext.accumulator(0), E.parse_event

    def counted(rows):
        def run(batches):
            for b in batches:
                parsed.add(b.num_rows)
                yield b
        return parse(rows.mapInArrow(run, rows.schema))

    monkeypatch.setattr(E, "parse_event", counted)
    got = [(r.repo, r.pr_number, r.pr_title, r.event_id) for r in RF.queued_prs(df, SECRET).collect()]
    assert got == [("o/r", 7, "T2", 6)] and parsed.value == 3          # 1, 5 and 6
    prs = RF.queued_prs(df, SECRET)
    spark.createDataFrame([("o/r", 7, f"f{i}.py", "+x") for i in range(50)], "repo string, pr_number long, filename string, patch string"
                          ).coalesce(1).write.parquet(str(tmp_path / "files"))
    files = RF.queued_files(spark.read.parquet(str(tmp_path / "files")), spark.createDataFrame(prs.collect(), prs.schema))
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and files.count() == 50
