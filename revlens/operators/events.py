"""Webhook deliveries: signature check, typed parse and routing.

Everything is a native expression: HMAC-SHA256 is built from ``sha2`` over
binary key pads, the body is parsed once into a VARIANT and fields are read
with ``try_variant_get`` (strict enough to tell malformed JSON (400) from a
schema error (422)), and the disposition is one ordered CASE.  No UDF, no
shuffle: the whole step is a row-local projection that scales with the
number of partitions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions.text import pr_description, short_sha
from revlens.operators.feedback import content_id
from revlens.session import settled, spread

# --------------------------------------------------------------- F05 signature


def _hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """HMAC key pads (RFC 2104) for a SHA-256 key of block size 64."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(secret: str, body) -> Column:
    """HMAC-SHA256(secret, body) as lower-case hex, as a Column expression."""
    ipad, opad = _hmac_pads(secret)
    msg = F.encode(F.col(body) if isinstance(body, str) else body, "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), msg), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def signature_check(secret: str | None, signature="signature", body="body") -> tuple[Column, Column]:
    """(http code or NULL when valid, reason) in the checker's order:
    no secret 500, missing header 401, not 'sha256=' 401, empty body 400,
    mismatch 401."""
    sig = F.coalesce(F.col(signature), F.lit(""))
    b = F.coalesce(F.col(body), F.lit(""))
    if not secret:
        return F.lit(500), F.lit("webhook secret not configured")
    expected = F.concat(F.lit("sha256="), hmac_sha256_hex(secret, b))
    code = (F.when(sig == "", F.lit(401))
            .when(~sig.startswith("sha256="), F.lit(401))
            .when(b == "", F.lit(400))
            .when(sig != expected, F.lit(401)))
    reason = (F.when(sig == "", F.lit("signature header missing"))
              .when(~sig.startswith("sha256="), F.lit("signature header malformed"))
              .when(b == "", F.lit("empty body"))
              .when(sig != expected, F.lit("signature mismatch")))
    return code, reason


def sign_body(secret: str, body) -> Column:
    """The header value a sender would attach: 'sha256=<hex>'."""
    return F.concat(F.lit("sha256="), hmac_sha256_hex(secret, body))


# --------------------------------------------------------------- S02 typed parse

# Fixed value: required fields of the pull_request payload, with types.
_REQUIRED = [
    ("action", "string"), ("number", "bigint"),
    ("pull_request.number", "bigint"), ("pull_request.title", "string"),
    ("pull_request.state", "string"), ("pull_request.html_url", "string"),
    ("pull_request.user.login", "string"), ("pull_request.user.id", "bigint"),
    ("pull_request.head.label", "string"), ("pull_request.head.ref", "string"),
    ("pull_request.head.sha", "string"),
    ("pull_request.base.label", "string"), ("pull_request.base.ref", "string"),
    ("pull_request.base.sha", "string"),
    ("repository.id", "bigint"), ("repository.name", "string"), ("repository.full_name", "string"),
    ("repository.html_url", "string"), ("repository.owner.login", "string"),
    ("sender.login", "string"), ("sender.id", "bigint"),
]
# Optional fields and their defaults.
_OPTIONAL = [
    ("pull_request.body", "string", None), ("pull_request.draft", "boolean", False),
    ("pull_request.user.type", "string", "User"),
    ("pull_request.additions", "bigint", 0), ("pull_request.deletions", "bigint", 0),
    ("pull_request.changed_files", "bigint", 0),
    ("repository.private", "boolean", False), ("repository.owner.id", "bigint", 0),
    ("repository.default_branch", "string", "main"), ("sender.type", "string", "User"),
]


def _schema_ddl(leaf_type=None) -> str:
    """The payload tree as a struct DDL; ``leaf_type`` overrides every leaf."""
    tree: dict = {}
    for path, typ, *_ in _REQUIRED + _OPTIONAL:
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = leaf_type or typ

    def ddl(node):
        return "struct<" + ",".join(f"{k}:{ddl(v) if isinstance(v, dict) else v}" for k, v in node.items()) + ">"
    return ddl(tree)


def _leaf(struct_col: Column, path: str) -> Column:
    c = struct_col
    for p in path.split("."):
        c = c[p]
    return c


# fixed values: words that stand for a boolean
_TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
_FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def _value(raw: Column, typ: str) -> Column:
    """A JSON leaf as a type, NULL where it cannot be one."""
    plain = F.try_variant_get(raw, "$", typ)
    if typ != "boolean":
        return plain
    word = F.lower(F.try_variant_get(raw, "$", "string"))
    return F.when(F.schema_of_variant(raw) == "STRING", F.when(word.isin(*_TRUE_WORDS), F.lit(True))
                  .when(word.isin(*_FALSE_WORDS), F.lit(False))).otherwise(plain)


def _fits(raw: Column, typ: str) -> Column:
    """Whether a JSON leaf may be read as a type."""
    kind = F.schema_of_variant(raw)
    if typ == "string":
        return kind == "STRING"
    number = F.try_variant_get(raw, "$", "double")
    if typ == "boolean":
        return F.when(kind.isin("BOOLEAN", "STRING"), F.lit(True)).otherwise(F.coalesce(number.isin(0.0, 1.0), F.lit(False)))
    return F.coalesce(number == F.floor(number), F.lit(False))


def parse_event(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``json_ok`` (body is JSON), ``schema_ok`` (validates),
    ``schema_error`` (first failing field) and ``event`` (typed struct E with
    defaults, SHAs lower-cased; only meaningful where ``schema_ok``).

    The body is parsed once and cast to the payload tree with VARIANT
    leaves; each leaf is then cast to its type, and its JSON type is read
    from the leaf, without re-parsing the text.  Whole numbers and numeric
    strings are integers, true / false, 0 / 1 and the usual words are booleans,
    text fields must be JSON strings; anything else present is a schema error,
    and null is allowed for the body only.
    """
    # files that nearly fill the cores are read as they lie, a shuffle would write every body
    few = max(1, df.sparkSession.sparkContext.defaultParallelism // 2)
    out = (spread(df, enough=few).withColumn("_v", F.try_parse_json(F.col(body)))
           .withColumn("_r", F.try_variant_get(F.col("_v"), "$", _schema_ddl("variant")))
           .withColumn("_ok", F.col("_v").isNotNull()))
    r = F.col("_r")
    leaves = {p: _value(_leaf(r, p), typ) for p, typ, *_ in _REQUIRED + _OPTIONAL}
    out = out.withColumn("_t", F.struct(*[leaves[p].alias(p.replace(".", "__")) for p in leaves]))
    t = F.col("_t")

    def _tl(p):
        return t[p.replace(".", "__")]
    checks = []
    for p, typ in _REQUIRED:
        checks.append((p, _tl(p).isNotNull() & _fits(_leaf(r, p), typ)))
    for p, typ, default in _OPTIONAL:
        raw = _leaf(r, p)
        ok = _tl(p).isNotNull() & _fits(raw, typ)
        # a field without a default may be null; the others may only be absent
        checks.append((p, raw.isNull() | ok | (F.is_variant_null(raw) if default is None else F.lit(False))))
    for p in ("pull_request.head.sha", "pull_request.base.sha"):
        checks.append((p, F.length(_tl(p)) >= S.MIN_SHA_LEN))
    # first failing field: a flat array of failures, not a 33-deep CASE
    first_error = F.try_element_at(F.array_compact(F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(p)) for p, ok in checks])), F.lit(1))

    def opt(p, d):
        val = _tl(p)
        return val if d is None else F.coalesce(val, F.lit(d))

    def ref(side):
        return F.struct(_tl(f"pull_request.{side}.label").alias("label"),
                        _tl(f"pull_request.{side}.ref").alias("ref"),
                        F.lower(_tl(f"pull_request.{side}.sha")).alias("sha"))

    pr = "pull_request"
    event = F.struct(
        _tl("action").alias("action"),
        _tl("number").alias("number"),
        F.struct(
            _tl(f"{pr}.number").alias("number"), _tl(f"{pr}.title").alias("title"),
            opt(f"{pr}.body", None).alias("body"), _tl(f"{pr}.state").alias("state"),
            opt(f"{pr}.draft", False).alias("draft"), _tl(f"{pr}.html_url").alias("html_url"),
            F.struct(_tl(f"{pr}.user.login").alias("login"), _tl(f"{pr}.user.id").alias("id"),
                     opt(f"{pr}.user.type", "User").alias("type")).alias("user"),
            ref("head").alias("head"), ref("base").alias("base"),
            opt(f"{pr}.additions", 0).alias("additions"), opt(f"{pr}.deletions", 0).alias("deletions"),
            opt(f"{pr}.changed_files", 0).alias("changed_files"),
        ).alias("pull_request"),
        F.struct(
            _tl("repository.id").alias("id"), _tl("repository.name").alias("name"),
            _tl("repository.full_name").alias("full_name"),
            opt("repository.private", False).alias("private"),
            _tl("repository.html_url").alias("html_url"),
            F.struct(_tl("repository.owner.login").alias("login"),
                     opt("repository.owner.id", 0).alias("id")).alias("owner"),
            opt("repository.default_branch", "main").alias("default_branch"),
        ).alias("repository"),
        F.struct(_tl("sender.login").alias("login"), _tl("sender.id").alias("id"),
                 opt("sender.type", "User").alias("type")).alias("sender"),
    )
    parsed = (out.withColumn("json_ok", F.col("_ok"))
              .withColumn("schema_error", F.when(F.col("json_ok"), first_error))
              .withColumn("schema_ok", F.col("json_ok") & F.col("schema_error").isNull())
              .withColumn("event", event)
              .drop("_v", "_ok", "_t", "_r"))
    # filters on the fields stay above, they would parse the body once for every field they need
    return settled(parsed, "json_ok", "schema_error", "schema_ok", "event")


# --------------------------------------------------------------- F01-F04 routing


def sha_ok(sha) -> Column:
    """a commit SHA must have at least 7 characters."""
    return F.length(F.col(sha) if isinstance(sha, str) else sha) >= S.MIN_SHA_LEN


def route(deliveries: DataFrame, secret: str | None, event_col: str = "event_name") -> DataFrame:
    """one disposition per delivery, in strict order
    signature -> event type -> JSON -> schema -> action -> draft -> queued.

    Adds: status (ok / ignored / rejected / queued), http_code, reason.
    """
    sig_code, sig_reason = signature_check(secret)
    parsed = parse_event(deliveries)
    ev = F.coalesce(F.col(event_col), F.lit("unknown"))            # F01
    action = F.col("event.action")
    reviewable = action.isin(*S.REVIEWABLE_ACTIONS)                 # F02
    draft = F.col("event.pull_request.draft")                       # F03
    status = (F.when(sig_code.isNotNull(), F.lit("rejected"))
              .when(ev == "ping", F.lit("ok"))
              .when(ev != "pull_request", F.lit("ignored"))
              .when(~F.col("json_ok"), F.lit("rejected"))
              .when(~F.col("schema_ok"), F.lit("rejected"))
              .when(~reviewable, F.lit("ignored"))
              .when(draft, F.lit("ignored"))
              .otherwise(F.lit("queued")))
    code = (F.when(sig_code.isNotNull(), sig_code)
            .when(ev == "ping", F.lit(200))
            .when(ev != "pull_request", F.lit(200))
            .when(~F.col("json_ok"), F.lit(400))
            .when(~F.col("schema_ok"), F.lit(422))
            .otherwise(F.lit(200)))
    reason = (F.when(sig_code.isNotNull(), sig_reason)
              .when(ev == "ping", F.lit("ping"))
              .when(ev != "pull_request", F.concat(F.lit("event '"), ev, F.lit("' is not a pull request")))
              .when(~F.col("json_ok"), F.lit("invalid JSON"))
              .when(~F.col("schema_ok"), F.concat(F.lit("payload schema error: "), F.col("schema_error")))
              .when(~reviewable, F.concat(F.lit("action '"), action, F.lit("' does not trigger review")))
              .when(draft, F.lit("draft PR"))
              .otherwise(F.lit("")))
    return settled(parsed.withColumns({"status": status, "http_code": code.cast("int"), "reason": reason}),
                   "status", "http_code", "reason")


def may_queue(secret: str | None, event_col: str = "event_name") -> Column:
    """False for a delivery that :func:`route` settles without its body: its signature fails or it is no pull request event."""
    return signature_check(secret)[0].isNull() & F.coalesce(F.col(event_col) == "pull_request", F.lit(False))


def pr_context(routed: DataFrame, keep: tuple[str, ...] = (), max_body_chars: int | None = S.MAX_PR_BODY) -> DataFrame:
    """PR context (flattened event) for queued deliveries, with X08 and X30;
    ``keep`` names columns of the delivery to carry along, ``max_body_chars``
    is the description's length as the event model shows it (None: whole)."""
    e = "event"
    q = routed.filter(F.col("status") == "queued")
    return q.select(
        F.col("delivery_id").alias("event_id"),
        content_id(F.lit("review"), F.col("delivery_id").cast("string")).alias("review_id"),   # the same on a re-run
        F.col(f"{e}.pull_request.number").alias("pr_number"),
        F.col(f"{e}.pull_request.title").alias("pr_title"),
        pr_description(F.col(f"{e}.pull_request.body"), max_body_chars).alias("pr_body"),
        F.col(f"{e}.pull_request.user.login").alias("pr_author"),
        F.col(f"{e}.pull_request.html_url").alias("pr_url"),
        F.col(f"{e}.pull_request.draft").alias("is_draft"),
        F.col(f"{e}.repository.full_name").alias("repo_full_name"),
        F.col(f"{e}.repository.owner.login").alias("repo_owner"),
        F.col(f"{e}.repository.name").alias("repo_name"),
        F.col(f"{e}.repository.private").alias("repo_private"),
        F.col(f"{e}.pull_request.base.sha").alias("base_sha"),
        F.col(f"{e}.pull_request.head.sha").alias("head_sha"),
        F.col(f"{e}.pull_request.base.ref").alias("base_ref"),
        F.col(f"{e}.pull_request.head.ref").alias("head_ref"),
        F.col(f"{e}.pull_request.additions").alias("additions"),
        F.col(f"{e}.pull_request.deletions").alias("deletions"),
        F.col(f"{e}.pull_request.changed_files").alias("changed_files"),
        F.col(f"{e}.action").alias("action"),
        F.col(f"{e}.sender.login").alias("sender"),
        *keep,
    )


def log_extra(ctx: DataFrame) -> Column:
    """Log-context record with 12-char SHAs."""
    return F.struct(F.col("review_id"), F.col("repo_full_name").alias("repo"), F.col("pr_number").alias("pr"),
                    F.col("pr_author").alias("author"), F.col("action"), short_sha("head_sha", S.SHORT_SHA).alias("head_sha"),
                    short_sha("base_sha", S.SHORT_SHA).alias("base_sha"), F.col("is_draft"), F.col("event_id"))


def queued_response(ctx: DataFrame) -> DataFrame:
    """The acknowledgement for a queued review (review id assigned at the sink)."""
    return ctx.select("event_id", F.lit("queued").alias("status"), F.col("pr_number").alias("pr"),
                      F.col("repo_full_name").alias("repo"), "action",
                      short_sha("head_sha", S.SHORT_SHA).alias("head_sha"))
