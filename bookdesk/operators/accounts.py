"""Accounts, one-time codes and tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import epoch_micros, norm_email, otp_hash
from ..plans.ordered import in_order, scan, starts_of, summaries
from ..plans.strategy import broadcast_if_small, next_ids
from .mutate import apply_patches, first_per_key, latest_per_key


# W3 ---------------------------------------------------------------------
def latest_otp(otps: DataFrame) -> DataFrame:
    """Newest code per (email, purpose) by (created_at, id)."""
    if "purpose" not in otps.columns:
        otps = otps.withColumn("purpose", F.lit("user_login"))
    return latest_per_key(otps, ["email", "purpose"], ["created_at", "id"])


# J7 ---------------------------------------------------------------------
def login_codes(otps: DataFrame) -> DataFrame:
    """The codes that a login may use: of the purpose ``user_login`` where codes have one."""
    return otps.filter(F.col("purpose") == "user_login") if "purpose" in otps.columns else otps


def _timeline(attempts: DataFrame, codes: DataFrame, a_ts: str, parts: int | None) -> DataFrame:
    """Attempts (``_kind`` 1) and codes (``_kind`` 0, their columns named ``_*``) in
    order of e-mail and time, a code before an attempt of the same moment."""
    a = attempts.withColumns({"_t": epoch_micros(F.col(a_ts)), "_kind": F.lit(1), "_tie": F.col("id").cast("bigint")})
    o = codes.withColumns({"_kind": F.lit(0), "_tie": F.col("_oid")}).filter("email IS NOT NULL")
    return in_order(a.unionByName(o, allowMissingColumns=True), "email", "_t", "_kind", "_tie", parts=parts)


class _Newest:
    """Which code is the newest of its e-mail, for each row of a sorted partition's batches."""

    def __init__(self, email: str | None):
        self.email = email  # of the row before the batch

    def sources(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """Per row the place of its code in the batch, -1 if that came before the batch and
        -2 if there is none; and where the rows of a code or an e-mail begin."""
        starts = starts_of(batch.column("email"), self.email)
        is_code = batch.column("_kind").to_numpy() == 0
        at = np.arange(len(starts))
        begin = np.maximum.accumulate(np.where(starts, at, -1))
        last = np.maximum.accumulate(np.where(is_code, at, -1))
        self.email = batch.column("email")[-1].as_py()
        return np.where(last >= np.maximum(begin, 0), last, np.where(begin < 0, -1, -2)), starts | is_code


_RECORD = ("_oid", "_hash", "_exp", "_max", "_a0", "_used0")


def _record(batch, at: int, fields) -> tuple:
    return tuple(batch.column(f)[at].as_py() for f in fields)


def _last_code(fields: tuple[str, ...]):
    """Summary of a partition: its first and last e-mail and the last one's newest code."""
    def run(batches: Iterator):
        first, newest, code = None, _Newest(None), None
        for k, b in enumerate(batches):
            first = b.column("email")[0].as_py() if k == 0 else first
            at = int(newest.sources(b)[0][-1])
            code = _record(b, at, fields) if at >= 0 else code if at == -1 else None
        return first, newest.email, code
    return run


def _codes_before(found: list) -> dict[int, tuple]:
    """(e-mail, newest code) of the row before each partition."""
    carried, now = {}, None
    for part, (first, last, code) in found:
        carried[part] = now
        if code is not None or first != last or now is None or now[0] != last:
            now = (last, code)
    return carried


def latest_before(attempts: DataFrame, otps: DataFrame, a_ts: str = "attempted_at", parts: int | None = None) -> DataFrame:
    """Backward as-of join: for each attempt the newest login code of its e-mail
    issued at or before it (a tie counts as before; of codes of one moment the later id).

    One scan over attempts and codes in order of (e-mail, time), dealt by ranges, so an
    e-mail with a large share of the rows spreads over partitions; each starts with the
    newest code before it. Attempts keep all their columns; those without e-mail have no code."""
    ordered = _timeline(attempts, login_codes(otps).select("email", epoch_micros(F.col("created_at")).alias("_t"),
                                                           F.col("id").cast("bigint").alias("_oid")), a_ts, parts)
    carried = _codes_before(summaries(ordered, _last_code(("_oid",))))
    cols = attempts.columns

    def step(before, batches: Iterator) -> Iterator:
        import pyarrow as pa
        email, code = before or (None, None)
        newest = _Newest(email)
        for b in batches:
            src, _ = newest.sources(b)
            known = pa.concat_arrays([pa.array([code and code[0]], pa.int64()), b.column("_oid").cast(pa.int64())])
            otp = known.take(pa.array(src + 1, mask=src == -2))
            code = (otp[-1].as_py(),) if otp[-1].is_valid else None
            mine = pa.array(b.column("_kind").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(mine) for c in cols), otp.filter(mine)], [*cols, "otp_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema.fields)
    return scan(ordered, carried, step, f"{schema}, otp_id bigint")


# R5 ---------------------------------------------------------------------
class _Tries:
    """Outcomes of attempts on their codes over the sorted batches of a partition. State between
    batches: the e-mail, its newest code, the wrong tries on it so far, and how many there were
    at the first right and timely one (None: no such yet)."""

    def __init__(self, email=None, code=None, tries=0, first=None):
        self.newest, self.code, self.tries, self.first = _Newest(email), code, tries, first
        self.inherited = True  # whether still at the code of before the partition

    def outcomes(self, b):
        import pyarrow as pa
        import pyarrow.compute as pc
        src, begins = self.newest.sources(b)
        n = len(src)
        none = pa.array(src == -2) if self.code is not None else pa.array(src < 0)
        place = pa.array(src + 1, mask=src == -2)

        def known(name: str, k: int):
            col = b.column(name)
            return pa.concat_arrays([pa.array([self.code and self.code[k]], col.type), col]).take(place)

        flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        attempt = b.column("_kind").to_numpy() == 1
        has_code = attempt & ~none.to_numpy(zero_copy_only=False)
        right = flag(pc.equal(b.column("_code"), known("_hash", 1)))
        expired = flag(pc.less(known("_exp", 2), b.column("_t")))
        most = pc.fill_null(known("_max", 3), 1 << 62).to_numpy()
        start_tries = pc.fill_null(known("_a0", 4), 0).to_numpy()
        used = known("_used0", 5).is_valid().to_numpy(zero_copy_only=False)

        wrong = (has_code & ~right).astype(np.int64)
        before = np.cumsum(wrong) - wrong
        begins = begins.copy()
        begins[0] = True
        seg_at = np.flatnonzero(begins)
        seg = np.cumsum(begins) - 1
        same = src[0] == -1  # the first rows go on with the code of before the batch
        base = start_tries[seg_at].astype(np.int64)
        if same:
            base[0] = self.tries
        tries = base[seg] + before - before[seg_at][seg]
        hit = np.minimum.reduceat(np.where(has_code & right & ~expired, np.arange(n), n), seg_at)
        first = np.where(hit < n, np.r_[tries, 0][hit], -1)
        if same and self.first is not None:
            first[0], hit[0] = self.first, -1
        ok_at = np.where((first >= 0) & (first < most[seg_at]), hit, n)
        used |= np.arange(n) > ok_at[seg]
        out = np.select([~has_code, used, expired, tries >= most, ~right],
                        ["no_otp", "already_used", "expired", "max_attempts", "invalid"], "ok")
        otp = known("_oid", 0)
        # the state after the batch
        end = int(src[-1])
        if end != -1:
            self.code, self.inherited = (_record(b, end, _RECORD) if end >= 0 else None), False
        self.tries = int(tries[-1] + wrong[-1])
        self.first = int(first[-1]) if first[-1] >= 0 else None
        return attempt, otp, out


def _tries_after(found: list, newest: dict[int, tuple]) -> dict[int, tuple]:
    """(e-mail, code, tries, first) of the row before each partition."""
    carried, now = {}, None
    for part, (email, code, tries, first, inherited) in found:
        carried[part] = now
        if inherited and now is not None:  # the counts go on with those of before
            tries, first = now[2] + tries, now[3] if now[3] is not None else None if first is None else now[2] + first
        now = (email, code, tries, first)
    return carried


def otp_outcomes(attempts: DataFrame, otps: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """attempts(id, email, attempted_at, code); otps(id, email, created_at,
    code_hash | code, expires_at, max_attempts[, attempts, consumed_at, purpose]).

    Per attempt in time order on its code: no_otp → already_used → expired
    (expires_at < t) → max_attempts (wrong tries so far ≥ max) → invalid →
    ok; a missing code is a wrong one. Returns (outcomes, otps' with attempts and consumed_at).

    One scan in order of (e-mail, time), dealt by ranges, whose partitions start with the newest
    code, its wrong tries and its first success of before; a hot e-mail or code spreads over
    partitions. Both inputs are read once, the ordered rows three times."""
    if "code_hash" not in otps.columns:
        otps = otps.withColumn("code_hash", otp_hash(F.col("code")))
    for c, v in (("attempts", F.lit(0)), ("consumed_at", F.lit(None).cast("timestamp_ntz"))):
        if c not in otps.columns:
            otps = otps.withColumn(c, v)
    codes = login_codes(otps).select(
        "email", epoch_micros(F.col("created_at")).alias("_t"), F.col("id").cast("bigint").alias("_oid"),
        F.col("code_hash").alias("_hash"), epoch_micros(F.col("expires_at")).alias("_exp"),
        F.col("max_attempts").cast("bigint").alias("_max"), F.col("attempts").cast("bigint").alias("_a0"),
        epoch_micros(F.col("consumed_at")).alias("_used0"))
    a = attempts.select("id", "email", "attempted_at", otp_hash(F.col("code")).alias("_code"))
    ordered = _timeline(a, codes, "attempted_at", parts)
    newest = _codes_before(summaries(ordered, _last_code(_RECORD)))

    def counted(batches: Iterator):
        from pyspark import TaskContext
        scanned = _Tries(*(newest.get(TaskContext.get().partitionId()) or ()))
        for b in batches:
            scanned.outcomes(b)
        return scanned.newest.email, scanned.code, scanned.tries, scanned.first, scanned.inherited

    carried = _tries_after(summaries(ordered, counted), newest)

    def step(before, batches: Iterator) -> Iterator:
        import pyarrow as pa
        scanned = _Tries(*(before or ()))
        for b in batches:
            attempt, otp, out = scanned.outcomes(b)
            mine = pa.array(attempt)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).filter(mine) for c in ("id", "email", "attempted_at")), otp.filter(mine), pa.array(out[attempt], pa.string())],
                ["id", "email", "attempted_at", "otp_id", "outcome"])

    schema = ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in ("id", "email", "attempted_at"))
    outcomes = scan(ordered, carried, step, f"{schema}, otp_id bigint, outcome string")
    per_otp = outcomes.groupBy("otp_id").agg(
        F.count_if(F.col("outcome") == "invalid").alias("_inv"),
        F.min(F.when(F.col("outcome") == "ok", F.col("attempted_at"))).alias("_ok_at"))
    o2 = otps.join(per_otp, otps["id"] == per_otp["otp_id"], "left").withColumns({
        "attempts": (F.col("attempts") + F.coalesce(F.col("_inv"), F.lit(0))).cast("int"),
        "consumed_at": F.coalesce(F.col("consumed_at"), F.col("_ok_at")),
    }).select(*otps.columns)
    return outcomes, o2


# R6 ---------------------------------------------------------------------
def _next_allowed(key: np.ndarray, t: np.ndarray, cooldown: int) -> np.ndarray:
    """For each request (sorted by key and time) the place of the first one of its key at
    least ``cooldown`` later; the number of requests where there is none."""
    n = len(t)
    order = np.lexsort((np.repeat([1, 0], n), np.r_[t, t + cooldown], np.r_[key, key]))
    is_request = order < n
    place = np.empty(n, np.int64)
    place[order[~is_request] - n] = np.cumsum(is_request)[~is_request]
    end = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, n]  # of each key's requests
    return np.where(place < end[np.searchsorted(end, np.arange(n), side="right")], place, n)


def _accepted(follows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Requests on the chains from ``starts``, by pointer doubling."""
    n = len(follows)
    on = np.zeros(n + 1, bool)
    on[starts] = True
    jump, size = np.r_[follows, n], 0
    while size != (size := int(on[:n].sum())) or (jump[:n][on[:n]] < n).any():
        on[jump[:n][on[:n]]] = True
        jump = jump[jump]
    return on[:n]


def _chain_ends(follows: np.ndarray) -> np.ndarray:
    """The last request of the chain from each one."""
    n = len(follows)
    end = np.where(follows < n, follows, np.arange(n))
    while (end != (end := end[end])).any():
        pass
    return end


def _cooldown_summary(cooldown: int):
    """(first e-mail, last e-mail, when the last may ask again if nothing was carried, and for a
    partition of one e-mail: by the time allowed before it, the time allowed after it)."""
    def run(batches: Iterator):
        t, first, last = [], None, None
        for k, b in enumerate(batches):
            starts = np.flatnonzero(starts_of(b.column("email"), last))
            first = b.column("email")[0].as_py() if k == 0 else first
            last = b.column("email")[-1].as_py()
            if len(starts):
                t = []  # only the last e-mail's requests matter
            t.append(b.column("_us").to_numpy()[starts[-1] if len(starts) else 0:])
        t = np.concatenate(t)
        ends = t[_chain_ends(_next_allowed(np.zeros(len(t), np.int64), t, cooldown))] + cooldown
        table = None
        if first is not None and first == last:
            near = slice(0, int(np.searchsorted(t, t[0] + cooldown, side="left")) + 1)
            ask, after = t[near], ends[near]
            keep = np.r_[after[1:] != after[:-1], True]  # the latest request that leads there
            table = ask[keep], after[keep], int(t[-1])
        return first, last, int(ends[0]), table
    return run


def _allowed_before(found: list) -> dict[int, tuple]:
    """(e-mail, when it may ask again) of the row before each partition."""
    carried, now = {}, None
    for part, (first, last, alone, table) in found:
        carried[part] = now
        if table is not None and now is not None and now[0] == last:
            ask, after, latest = table
            if now[1] <= latest:
                now = (last, int(after[np.searchsorted(ask, now[1], side="left")]))
        else:
            now = (last, alone)
    return carried


def otp_rate_limit(requests: DataFrame, cooldown_seconds: int = 60, ts_col: str = "created_at",
                   parts: int | None = None) -> DataFrame:
    """Accepted requests: one is accepted when the last *accepted* request
    of its e-mail is at least ``cooldown`` old (greedy; rejected requests do
    not reset the clock). Requests without e-mail are all accepted.

    One scan in order of (e-mail, time, id), dealt by ranges: an e-mail of any size spreads over
    partitions. Each request points to the first one that may follow it, and the
    accepted ones are the chain of these pointers from an e-mail's first, found by pointer
    doubling. A partition within one e-mail is a step function from the time allowed
    before it to the time allowed after it, of one step a distinct chain; these
    functions are applied one after another, which gives each partition its start."""
    cooldown = int(cooldown_seconds * 1_000_000)
    timed = requests.withColumn("_us", epoch_micros(F.col(ts_col)))
    ordered = in_order(timed, "email", "_us", "id", parts=parts)
    carried = _allowed_before(summaries(ordered.select("email", "_us"), _cooldown_summary(cooldown)))
    cols = requests.columns

    def step(before, batches: Iterator) -> Iterator:
        import pyarrow as pa
        email, allowed = before or (None, None)
        for b in batches:
            starts = starts_of(b.column("email"), email)
            t = b.column("_us").to_numpy()
            key = np.cumsum(starts)
            begin = np.flatnonzero(starts)
            if not starts[0]:  # goes on with the e-mail of before
                end = begin[0] if len(begin) else len(t)
                at = int(np.searchsorted(t[:end], allowed, side="left"))
                begin = np.r_[at, begin] if at < end else begin
            keep = _accepted(_next_allowed(key, t, cooldown), begin)
            email = b.column("email")[-1].as_py()
            mine = keep & (key == key[-1])
            if mine.any():
                allowed = int(t[np.flatnonzero(mine)[-1]]) + cooldown
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in cols], cols)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return scan(ordered, carried, step, schema)


# J8 ---------------------------------------------------------------------
def token_validity(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests(request_id, jti, requested_at[, expires_at]): rejected when
    the jti was revoked at or before the request, or the token (JWT life)
    has expired; an unknown jti is accepted."""
    t = tokens.select(F.col("jti").alias("_jti"), F.col("revoked_at").alias("_rev"),
                      F.col("expires_at").alias("_exp"))
    j = requests.join(t, requests["jti"] == t["_jti"], "left")
    exp = F.col("expires_at") if "expires_at" in requests.columns else F.col("_exp")
    status = (F.when(exp.isNotNull() & (exp <= F.col("requested_at")), "expired")
              .when(F.col("_rev").isNotNull() & (F.col("_rev") <= F.col("requested_at")), "revoked")
              .otherwise("ok"))
    return j.withColumn("status", status).drop("_jti", "_rev", "_exp")


# M4 ---------------------------------------------------------------------
PROFILE_FIELDS = [
    "first_middle_name", "last_name", "gender", "date_of_birth", "nationality", "marital_status",
    "anniversary", "city_of_residence", "state", "country", "mobile_country_code", "mobile_number",
    "passport_no", "passport_expiry", "passport_issuing_country", "pan_card_number", "profile_image",
]


def patch_users(u: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches(request_id, user_id, patch map, requested_at): each whitelisted
    key present is written (an explicit null clears). Each patch judges anew
    whether the profile is complete: by its own names where it gives any, else
    by those stored before it, so the last patch decides."""
    types = dict((f.name, f.dataType) for f in u.schema.fields)
    present_any = None
    for k in PROFILE_FIELDS:
        c = F.map_contains_key("patch", F.lit(k))
        present_any = c if present_any is None else (present_any | c)
    p = patches.withColumn("_outcome", F.when(~present_any, "no_fields"))
    rules = {k: ((lambda m, k=k: F.element_at(m, F.lit(k)).cast(types[k])), "present") for k in PROFILE_FIELDS}

    # What a name is judged by: the last patch's own, unless that is empty; then what the patches
    # before it stored, else the user's. Only users whose last patch empties a name need
    # the patches before it looked at once more.
    order, names = F.struct("requested_at", "request_id"), ("first_middle_name", "last_name")
    given = lambda k: F.map_contains_key("patch", F.lit(k))
    own = lambda k: F.nullif(F.element_at("patch", F.lit(k)), F.lit(""))
    emptied = reduce(lambda a, b: a | b, (given(k) & own(k).isNull() for k in names))
    last = F.max_by(F.struct(*(given(k).alias(f"g_{k}") for k in names), *(own(k).alias(f"o_{k}") for k in names)), order)

    def completeness(df: DataFrame, ok: DataFrame) -> DataFrame:
        ends = ok.groupBy(F.col("user_id").alias("_eu")).agg(F.max(order).alias("_eo"), F.max_by(emptied, order).alias("_e"))
        ends = ends.filter("_e").drop("_e")
        before = ok.join(broadcast_if_small(ends), ok["user_id"] == ends["_eu"]).filter(order < F.col("_eo"))
        stored = before.groupBy(F.col("user_id").alias("_su")).agg(
            *(F.max_by(F.element_at("patch", F.lit(k)), F.when(given(k), order)).alias(f"_s_{k}") for k in names),
            *(F.max(given(k)).alias(f"_g_{k}") for k in names))
        df = df.join(broadcast_if_small(stored), df["id"] == stored["_su"], "left")
        done = F.lit(True)
        for k in names:
            of_last = F.col(f"_last.g_{k}")
            held = F.when(of_last & F.coalesce(F.col(f"_g_{k}"), F.lit(False)), F.col(f"_s_{k}")).when(
                ~of_last & F.coalesce(F.col(f"_h_{k}"), F.lit(False)), F.col(f"_v_{k}")).otherwise(F.col(k))
            done &= F.coalesce(F.col(f"_last.o_{k}"), held, F.lit("")) != ""
        return df.withColumn("is_profile_complete",
                             F.when(F.col("_touched").isNotNull(), done).otherwise(F.col("is_profile_complete")))
    return apply_patches(u, p, "user_id", rules, extra=completeness, aggs=(last.alias("_last"),))


# M5 ---------------------------------------------------------------------
def complete_profiles(u: DataFrame, forms: DataFrame) -> DataFrame:
    """forms(user_id, first_middle_name, last_name, mobile_number,
    mobile_country_code, country, date_of_birth, gender, submitted_at[,
    form_id]): names
    are set by the last form; each form keeps those of the other five that it
    does not state, so the last stated value of each stays."""
    # total order: re-running a task picks the same form
    order = F.struct("submitted_at", *(["form_id"] if "form_id" in forms.columns else []))
    kept = ("mobile_number", "mobile_country_code", "country", "date_of_birth", "gender")
    n = forms.groupBy(F.col("user_id").alias("_n_user_id")).agg(
        *(F.max_by(c, order).alias(f"_n_{c}") for c in ("first_middle_name", "last_name", "submitted_at")),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_n_{c}") for c in kept))
    j = u.join(broadcast_if_small(n), u["id"] == n["_n_user_id"], "left")
    hit = F.col("_n_user_id").isNotNull()
    sets = {"first_middle_name": F.trim(F.col("_n_first_middle_name")), "last_name": F.trim(F.col("_n_last_name")),
            "is_profile_complete": F.lit(True), "updated_at": F.col("_n_submitted_at")}
    for c in kept:
        sets[c] = F.coalesce(F.col(f"_n_{c}").cast(u.schema[c].dataType), F.col(c))
    return j.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in sets.items()}).select(*u.columns)


# M6 ---------------------------------------------------------------------
USER_STATUSES = ("active", "inactive", "suspended")


def set_user_status(u: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(request_id, user_id, status, requested_at)."""
    p = changes.withColumns({
        "patch": F.create_map(F.lit("status"), F.col("status")),
        "_outcome": F.when(~F.coalesce(F.col("status").isin(*USER_STATUSES), F.lit(False)), "invalid_status"),
    })
    return apply_patches(u, p, "user_id", {"status": (lambda m: F.element_at(m, F.lit("status")), "value")})


# M7 ---------------------------------------------------------------------
def upsert_admins(a: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(seed_id, email, password_hash, name, role, seeded_at): by
    e-mail (normalised), refresh hash/name/role and re-activate; unseen
    e-mails are inserted with id ``max(id) + seed_id``."""
    from .mutate import upsert
    s = latest_per_key(seeds.withColumn("email", norm_email(F.col("email"))), ["email"], ["seeded_at", "seed_id"])
    sets = {"password_hash": F.col("n_password_hash"), "name": F.col("n_name"), "role": F.col("n_role"),
            "status": F.lit("active"), "updated_at": F.col("n_seeded_at")}
    ins = {"email": F.col("n_email"), "password_hash": F.col("n_password_hash"), "name": F.col("n_name"),
           "role": F.coalesce(F.col("n_role"), F.lit("admin")), "status": F.lit("active"),
           "created_at": F.col("n_seeded_at"), "updated_at": F.col("n_seeded_at")}
    return upsert(a, s, "email", sets, ins, id_offset=F.col("n_seed_id"))


# M8 ---------------------------------------------------------------------
def login_users(u: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """logins(id, email, logged_in_at): unseen e-mails become users (first
    login wins the id), every user gets last_login_at = latest login.
    Returns (users', new users)."""
    lg = logins.withColumn("email", norm_email(F.col("email")))
    firsts = first_per_key(lg, ["email"], ["logged_in_at", "id"])
    new = firsts.join(u.select("email"), "email", "left_anti")
    new_rows = new.select(next_ids(u, F.col("id")).alias("id"), "email",
                          F.col("logged_in_at").alias("created_at"))
    last = lg.groupBy("email").agg(F.max("logged_in_at").alias("_last"))
    full_new = new_rows
    for f in u.schema.fields:
        if f.name not in full_new.columns:
            full_new = full_new.withColumn(f.name, F.lit(None).cast(f.dataType))
    defaults = {"mobile_verified": F.lit(False), "is_profile_complete": F.lit(False), "status": F.lit("active"),
                "updated_at": F.col("created_at")}
    full_new = full_new.withColumns({k: v for k, v in defaults.items() if k in u.columns}).select(*u.columns)
    allu = u.unionByName(full_new)
    j = allu.join(last, "email", "left")
    out = j.withColumn("last_login_at", F.coalesce(F.col("_last"), F.col("last_login_at"))).select(*u.columns)
    return out, full_new


# M9 ---------------------------------------------------------------------
def revoke_tokens(t: DataFrame, logouts: DataFrame) -> DataFrame:
    """logouts(jti, logged_out_at): a logout passes the token check only
    while the token is unrevoked, so the earliest one wins; revoked_at is
    the earlier of the stored stamp and the first logout."""
    lo = logouts.groupBy("jti").agg(F.min("logged_out_at").alias("_out"))
    j = t.join(broadcast_if_small(lo), "jti", "left")
    return j.withColumn("revoked_at", F.least(F.col("revoked_at"), F.col("_out"))).select(*t.columns)
