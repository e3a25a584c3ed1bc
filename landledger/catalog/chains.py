"""Queries on registers, orders, the audit trail and the request limiter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landledger import fixed
from landledger.catalog import query
from landledger.catalog.sqlparts import place, sim, toks
from landledger.functions import orders as order_words
from landledger.functions import shares
from landledger.functions.text import name_tokens
from landledger.operators import audit, chain, decisions, limiter, orders
from landledger.plans import views
from landledger.plans.views import NOW, oracle_with
from landledger.session import settle, stored

MUT = oracle_with("v_mutations")
_DAY = "DATE '1990-01-01' + CAST(effective_day AS INTEGER)"

# Entries that stand, a correction in the place of the entry it goes back to.
STANDING = f"""{MUT}, walk AS (
  SELECT parcel_id, id, seq AS place, supersedes_id AS cursor, 0 AS depth FROM v_mutations WHERE supersedes_id IS NOT NULL
  UNION ALL SELECT w.parcel_id, w.id, m.seq, m.supersedes_id, w.depth + 1 FROM walk w JOIN v_mutations m ON m.parcel_id = w.parcel_id AND m.id = w.cursor),
position AS (SELECT parcel_id, id, arg_max(place, depth) AS position FROM walk GROUP BY parcel_id, id),
standing AS (SELECT m.parcel_id, m.id, CAST(coalesce(p.position, m.seq) AS BIGINT) AS seq, type, from_owner, to_owner, share, mutation_number, {_DAY} AS effective_date
  FROM v_mutations m LEFT JOIN position p USING (parcel_id, id)
  WHERE NOT EXISTS (SELECT 1 FROM v_mutations s WHERE s.parcel_id = m.parcel_id AND s.supersedes_id = m.id))"""


def standing_of(spark, sf):
    return chain.standing_entries(views.mutations(spark, sf))


# --- register order ------------------------------------------------------

@query(f"""{STANDING} SELECT parcel_id, id, seq, type, CAST(effective_date AS VARCHAR) AS effective_date, true AS stands FROM standing
UNION ALL SELECT parcel_id, id, seq, type, CAST({_DAY} AS VARCHAR), false FROM v_mutations m WHERE EXISTS (SELECT 1 FROM v_mutations s WHERE s.parcel_id = m.parcel_id AND s.supersedes_id = m.id)""")
def standing_entries(spark, sf):
    columns = ["parcel_id", "id", "seq", "type", "effective_date"]
    replaced = chain.replaced_entries(views.mutations(spark, sf)).select(*columns).withColumn("stands", F.lit(False))
    return standing_of(spark, sf).select(*columns).withColumn("stands", F.lit(True)).unionByName(replaced)


@query(f"{STANDING} SELECT parcel_id, id, CAST(position AS BIGINT) AS position FROM position")
def correction_position(spark, sf):
    return chain.correction_position(views.mutations(spark, sf))


@query(f"""{MUT} SELECT parcel_id, id, row_number() OVER (PARTITION BY parcel_id ORDER BY effective_day, seq, id) AS place
FROM v_mutations m WHERE NOT EXISTS (SELECT 1 FROM v_mutations s WHERE s.parcel_id = m.parcel_id AND s.supersedes_id = m.id)""")
def ownership_history(spark, sf):
    return chain.ownership_history(views.mutations(spark, sf)).select("parcel_id", "id", "place")


@query(f"""{STANDING}, latest AS (SELECT *, max({{'d': effective_date, 'n': -seq}}) OVER (PARTITION BY parcel_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM standing)
SELECT parcel_id, seq, CAST(effective_date AS VARCHAR) AS date, -before.n AS prev_seq, CAST(before.d AS VARCHAR) AS prev_date FROM latest WHERE effective_date < before.d""")
def backdated(spark, sf):
    return chain.backdated(standing_of(spark, sf)).selectExpr(
        "parcel_id", "seq", "params['date'] as date", "cast(params['prevSeq'] as bigint) as prev_seq", "params['prevDate'] as prev_date"
    )


@query(f"{STANDING} SELECT parcel_id, seq, CAST(effective_date AS VARCHAR) AS date FROM standing WHERE effective_date > TIMESTAMP '{NOW}' + INTERVAL 1 DAY")
def future_dated(spark, sf):
    return chain.future_dated(standing_of(spark, sf), NOW).selectExpr("parcel_id", "seq", "params['date'] as date")


@query(f"""{STANDING}, firsts AS (SELECT *, first_value(seq) OVER w AS first_seq, row_number() OVER w AS rn FROM standing WINDOW w AS (PARTITION BY parcel_id, mutation_number ORDER BY seq, id))
SELECT parcel_id, seq, mutation_number AS number, first_seq FROM firsts WHERE rn > 1""")
def duplicate_numbers(spark, sf):
    return chain.duplicate_numbers(standing_of(spark, sf)).selectExpr(
        "parcel_id", "seq", "params['number'] as number", "cast(params['first'] as bigint) as first_seq"
    )


@query(f"""{STANDING}, t AS (SELECT parcel_id, min(effective_date) AS a, max(effective_date) AS b FROM standing GROUP BY parcel_id)
SELECT parcel_id, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day,
  floor(CAST(b - a AS DOUBLE) / 365.25::DOUBLE * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS years FROM t""")
def chain_span(spark, sf):
    return chain.chain_span(standing_of(spark, sf))


# --- replay --------------------------------------------------------------
# The check replays each register as one fold over its entries. Shares are counted in
# parts of 2^5 * 3^5, which holds every sum the view can produce; names are the same
# person when their sorted words agree, which the view's names reduce to.

_UNIT = 2**5 * 3**5
_PARTS = f"""CASE WHEN regexp_full_match(share, '[0-9]+/[0-9]+') THEN {_UNIT} * CAST(split_part(share, '/', 1) AS BIGINT) // CAST(split_part(share, '/', 2) AS BIGINT)
  WHEN regexp_full_match(share, '[0-9]+') THEN {_UNIT} * CAST(share AS BIGINT) ELSE NULL END"""


def _who(x: str) -> str:
    return f"array_to_string(list_sort({toks(x)}), ' ')"


_STATE = (
    "{'h': []::STRUCT(w VARCHAR, p BIGINT)[], 'died': []::VARCHAR[], 'gone': []::VARCHAR[], "
    "'settled': []::VARCHAR[], 'out': []::STRUCT(seq BIGINT, code VARCHAR, x VARCHAR)[]}"
)


def _credit(holders: str, who: str, part: str) -> str:
    return (
        f"CASE WHEN len(list_filter({holders}, lambda z: z.w = {who})) > 0 THEN "
        f"list_transform({holders}, lambda z: {{'w': z.w, 'p': z.p + CASE WHEN z.w = {who} THEN {part} ELSE 0 END}}) "
        f"ELSE list_append({holders}, {{'w': {who}, 'p': {part}}}) END"
    )


def _flag(code: str, amounts: str = "''") -> str:
    """A finding; ``amounts`` are the shares that its text names."""
    return f"list_append(s.out, {{'seq': e.seq, 'code': {code}, 'x': {amounts}}})"


def _same(**changed: str) -> str:
    keys = ("h", "died", "gone", "settled", "out")
    return "{" + ", ".join(f"'{k}': {changed.get(k, 's.' + k)}" for k in keys) + "}"


_HELD = "list_filter(s.h, lambda z: z.w = e.f)[1].p"
_REST = "list_filter(s.h, lambda z: z.w <> e.f)"
_HEIRS = f"list_reduce(e.heirs, lambda hs, x: {_credit('hs', 'x.w', 'x.p')}, {_REST})"
_TOTAL = "list_sum(list_transform(e.heirs, lambda x: x.p))"
_AMOUNTS = f"CAST({_TOTAL} AS VARCHAR) || '/' || CAST({_HELD} AS VARCHAR)"
_LEFT = f"CASE WHEN {_HELD} = e.p THEN {_REST} ELSE list_transform(s.h, lambda z: {{'w': z.w, 'p': z.p - CASE WHEN z.w = e.f THEN e.p ELSE 0 END}}) END"
_STEP = f"""CASE
  WHEN e.p IS NULL THEN {_same(out=_flag("'unreadableShare'"))}
  WHEN e.type = 'ORIGINAL' THEN {_same(h=_credit('s.h', 'e.t', 'e.p'))}
  WHEN e.f IS NULL THEN {_same(out=_flag("'missingTransferor'"))}
  WHEN e.type = 'INHERITANCE' AND list_contains(s.settled, e.k) THEN s
  WHEN len(list_filter(s.h, lambda z: z.w = e.f)) = 0 THEN {_same(out=_flag(
      "CASE WHEN list_contains(s.died, e.f) THEN 'deceasedTransferor' WHEN list_contains(s.gone, e.f) THEN 'doubleSale' ELSE 'chainBreak' END"))}
  WHEN e.type = 'INHERITANCE' THEN {_same(h=_HEIRS, died='list_append(s.died, e.f)', settled='list_append(s.settled, e.k)', out=(
      f"CASE WHEN {_TOTAL} > {_HELD} THEN " + _flag("'sharesExceedWhole'", _AMOUNTS) + f" WHEN {_TOTAL} < {_HELD} THEN " + _flag("'undistributed'", _AMOUNTS) + " ELSE s.out END"))}
  WHEN e.p > {_HELD} THEN {_same(out=_flag("'overTransfer'", f"CAST({_HELD} AS VARCHAR)"))}
  ELSE {_same(h=_credit(f'({_LEFT})', 'e.t', 'e.p'), gone=f"CASE WHEN {_HELD} = e.p THEN list_append(s.gone, e.f) ELSE s.gone END")}
END"""


def replay_of(standing: str, p: str = "") -> str:
    """CTEs, their names after ``p``, that replay the registers of ``standing``: findings in order, and holders."""
    return f"""{p}parts AS (SELECT *, {_PARTS} AS p, {_who('from_owner')} AS fw, {_who('to_owner')} AS tw FROM {standing}),
{p}heirs AS (SELECT parcel_id, from_owner, effective_date, list({{'w': tw, 'p': coalesce(p, 0)}} ORDER BY seq, id) AS heirs
  FROM {p}parts WHERE type = 'INHERITANCE' AND from_owner IS NOT NULL GROUP BY ALL),
{p}entries AS (SELECT a.parcel_id, list({{'seq': seq, 'type': type, 'p': p, 'f': CASE WHEN a.from_owner IS NULL THEN NULL ELSE fw END, 't': tw,
    'k': a.from_owner || '|' || CAST(a.effective_date AS VARCHAR), 'heirs': coalesce(heirs, [])}} ORDER BY a.effective_date, seq, id) AS es
  FROM {p}parts a LEFT JOIN {p}heirs h ON a.type = 'INHERITANCE' AND h.parcel_id = a.parcel_id AND h.from_owner = a.from_owner AND h.effective_date = a.effective_date
  GROUP BY a.parcel_id),
{p}opened AS (SELECT parcel_id, es, es[1] AS e0, CASE WHEN es[1].type = 'ORIGINAL' OR es[1].f IS NULL THEN NULL
    WHEN es[1].type = 'INHERITANCE' THEN list_sum(list_transform(es[1].heirs, lambda x: x.p)) ELSE es[1].p END AS opening FROM {p}entries),
{p}replayed AS (SELECT parcel_id, list_reduce(es, lambda s, e: {_STEP},
    CASE WHEN opening > 0 THEN {{'h': [{{'w': e0.f, 'p': CAST(opening AS BIGINT)}}], 'died': []::VARCHAR[], 'gone': []::VARCHAR[], 'settled': []::VARCHAR[], 'out': [{{'seq': e0.seq, 'code': 'titleNotTraced', 'x': ''}}]}}
         ELSE {_STATE} END) AS st FROM {p}opened),
{p}over AS (SELECT parcel_id, list_sum(list_transform(st.h, lambda z: z.p)) AS total FROM {p}replayed
  WHERE total > {_UNIT} AND len(list_filter(st.out, lambda z: z.code = 'sharesExceedWhole')) = 0),
{p}replay_found AS (SELECT parcel_id, n, f.seq AS seq, f.code AS code, f.x AS x FROM (SELECT parcel_id, unnest(st.out) AS f, unnest(range(len(st.out))) AS n FROM {p}replayed) z
  UNION ALL SELECT parcel_id, 1000000, NULL, 'sharesExceedWholeTotal', CAST(total AS VARCHAR) FROM {p}over),
{p}held AS (SELECT parcel_id, h.w AS who, h.p AS p FROM (SELECT parcel_id, unnest(st.h) AS h FROM {p}replayed) z WHERE h.p <> 0)"""


REPLAY = f"{STANDING}, {replay_of('standing')}"

CHAIN = f"""{REPLAY}, latest AS (SELECT *, max(effective_date) OVER (PARTITION BY parcel_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY parcel_id, mutation_number ORDER BY seq, id) AS rn FROM standing),
all_found AS (SELECT parcel_id, seq, code FROM replay_found
  UNION ALL SELECT parcel_id, seq, 'backdated' FROM latest WHERE effective_date < before
  UNION ALL SELECT parcel_id, seq, 'futureDated' FROM latest WHERE effective_date > TIMESTAMP '{NOW}' + INTERVAL 1 DAY
  UNION ALL SELECT parcel_id, seq, 'duplicateNumber' FROM latest WHERE rn > 1)"""
CRITICAL = ", ".join(f"'{k}'" for k, v in {**fixed.SEVERITY, "sharesExceedWholeTotal": "critical"}.items() if v == "critical")


@query(f"{REPLAY} SELECT parcel_id, seq, code FROM replay_found")
def chain_replay(spark, sf):
    return chain.replay_findings(chain.chain_replay(standing_of(spark, sf))).select("parcel_id", "seq", "code")


def _parts_of(column: str) -> str:
    f = shares.parse_share(column)
    return f"transform(array({f}), f -> f.n * {_UNIT} div f.d)[0]"


@query(f"{REPLAY} SELECT parcel_id, who, p AS parts FROM held")
def holders_current(spark, sf):
    held = chain.holders_current(chain.chain_replay(standing_of(spark, sf)))
    who = f"array_join(array_sort({name_tokens('owner')}), ' ')"
    return held.selectExpr("parcel_id", f"{who} as who", f"{_parts_of('share')} as parts")


_APPLIED = f"""CASE WHEN e.p IS NULL THEN false WHEN e.type = 'ORIGINAL' THEN true WHEN e.f IS NULL THEN false
  WHEN e.type = 'INHERITANCE' AND list_contains(s.settled, e.k) THEN true WHEN len(list_filter(s.h, lambda z: z.w = e.f)) = 0 THEN false
  WHEN e.type = 'INHERITANCE' THEN true ELSE e.p <= {_HELD} END"""
_HOLDINGS = "list_sort(list_transform(list_filter({}, lambda z: z.p <> 0), lambda z: z.w || '=' || CAST(z.p AS VARCHAR)))"


@query(f"""{REPLAY}, walked AS (SELECT o.parcel_id, list_reduce(es, lambda t, e: list_transform([t.s], lambda s: {{
    's': {_STEP}, 'steps': list_append(t.steps, {{'seq': e.seq, 'applied': {_APPLIED}, 'after': {_STEP}.h}})}})[1],
    {{'s': CASE WHEN opening > 0 THEN {{'h': [{{'w': e0.f, 'p': CAST(opening AS BIGINT)}}], 'died': []::VARCHAR[], 'gone': []::VARCHAR[], 'settled': []::VARCHAR[], 'out': []::STRUCT(seq BIGINT, code VARCHAR, x VARCHAR)[]}}
         ELSE {_STATE} END, 'steps': []::STRUCT(seq BIGINT, applied BOOLEAN, after STRUCT(w VARCHAR, p BIGINT)[])[]}}) AS w FROM opened o),
steps AS (SELECT parcel_id, unnest(w.steps) AS x, unnest(range(len(w.steps))) AS n FROM walked)
SELECT parcel_id, n, x.seq AS seq, x.applied AS applied, array_to_string({_HOLDINGS.format('x.after')}, ', ') AS held FROM steps""")
def holder_steps(spark, sf):
    steps = chain.holder_steps(standing_of(spark, sf))
    who = f"array_join(array_sort({name_tokens('h.owner')}), ' ')"
    held = f"array_join(array_sort(transform(holders, h -> concat({who}, '=', {_parts_of('h.share')}))), ', ')"
    turn = F.row_number().over(Window.partitionBy("parcel_id").orderBy("ord")) - 1
    return steps.withColumn("n", turn).selectExpr("parcel_id", "n", "seq", "applied", f"{held} as held")


@query(f"""{REPLAY} SELECT parcel_id, CAST(sum(p) AS BIGINT) AS parts, sum(p) > {_UNIT} AS over_whole FROM held GROUP BY parcel_id""")
def shares_total(spark, sf):
    held = chain.holders_current(chain.chain_replay(standing_of(spark, sf)))
    return held.groupBy("parcel_id").agg(F.expr(f"sum({_parts_of('share')})").alias("parts")).withColumn(
        "over_whole", F.col("parts") > _UNIT
    )


def owners_for(spark, sf):
    """The record of each register names its last buyer, or a stranger in one of six."""
    last = views.mutations(spark, sf).groupBy("parcel_id").agg(F.max_by("to_owner", "seq").alias("last"))
    return last.selectExpr(
        "parcel_id as document_id", "parcel_id", "if(parcel_id % 6 = 0, 'stranger 0', last) as owner_name"
    )


@query(f"""{REPLAY}, owners AS (SELECT parcel_id, CASE WHEN parcel_id % 6 = 0 THEN 'stranger 0' ELSE arg_max(to_owner, seq) END AS owner FROM v_mutations GROUP BY parcel_id),
j AS (SELECT o.parcel_id, count(*) AS holders, count(*) FILTER (who = {_who('owner')}) AS mine FROM owners o JOIN held h USING (parcel_id) GROUP BY o.parcel_id)
SELECT parcel_id AS document_id, CASE WHEN mine = 0 THEN 'unrecordedTransfer' ELSE 'unlistedCoOwners' END AS code FROM j WHERE mine = 0 OR holders > 1""")
def owner_vs_chain(spark, sf):
    found = chain.owner_vs_chain(owners_for(spark, sf), chain.chain_replay(standing_of(spark, sf)))
    return found.selectExpr("document_id", "issues[0].code as code")


@query(f"""{CHAIN}, c AS (SELECT parcel_id, count(*) FILTER (code IN ({CRITICAL})) AS critical, count(*) FILTER (code NOT IN ({CRITICAL})) AS warnings FROM all_found GROUP BY parcel_id),
n AS (SELECT parcel_id, count(*) AS entries FROM standing GROUP BY parcel_id), registers AS (SELECT DISTINCT o_orderkey * 2 AS parcel_id FROM orders)
SELECT r.parcel_id, coalesce(entries, 0) AS entries, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings,
  CASE WHEN entries IS NULL THEN 'EMPTY' WHEN coalesce(critical, 0) + coalesce(warnings, 0) > 0 THEN 'DEFECTS' ELSE 'CLEAN' END AS chain_status
FROM registers r LEFT JOIN n USING (parcel_id) LEFT JOIN c USING (parcel_id)""")
def chain_status(spark, sf):
    standing = settle(standing_of(spark, sf))
    registers = views.base(spark, sf, "orders").selectExpr("o_orderkey * 2 as parcel_id")
    return chain.chain_status(registers, standing, chain.chain_findings(standing, NOW))


# --- shares --------------------------------------------------------------

_SHARES = """s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN CAST(event_id % 9 + 1 AS VARCHAR) || '/' || CAST(event_id % 12 AS VARCHAR)
  WHEN 2 THEN '0.' || CAST(event_id % 1000 AS VARCHAR) WHEN 3 THEN 'half' WHEN 4 THEN ' 2 / 6 ' ELSE '12/18' END AS text, event_id % 7 + 1 AS bn, event_id % 11 + 2 AS bd FROM events),
r AS (SELECT *, CASE WHEN regexp_full_match(trim(text), '[0-9]+ */ *[0-9]+') THEN CAST(trim(split_part(text, '/', 1)) AS BIGINT)
    WHEN regexp_full_match(text, '0[.][0-9]+') THEN CAST(substr(text, 3) AS BIGINT) WHEN text = '1' THEN 1 END AS n0,
  CASE WHEN regexp_full_match(trim(text), '[0-9]+ */ *[0-9]+') THEN nullif(CAST(trim(split_part(text, '/', 2)) AS BIGINT), 0)
    WHEN regexp_full_match(text, '0[.][0-9]+') THEN CAST(pow(10, length(text) - 2) AS BIGINT) WHEN text = '1' THEN 1 END AS d0 FROM s),
f AS (SELECT *, CASE WHEN d0 IS NULL THEN NULL ELSE n0 // greatest(gcd(n0, d0), 1) END AS n, CASE WHEN d0 IS NULL THEN NULL ELSE d0 // greatest(gcd(n0, d0), 1) END AS d FROM r)"""
_SHARE_TEXT = (
    "case cast(event_id % 6 as int) when 0 then '1' when 1 then concat(event_id % 9 + 1, '/', event_id % 12) "
    "when 2 then concat('0.', event_id % 1000) when 3 then 'half' when 4 then ' 2 / 6 ' else '12/18' end"
)


@query(f"WITH {_SHARES} SELECT event_id, n, d FROM f")
def parse_share(spark, sf):
    texts = views.base(spark, sf, "events").selectExpr("event_id", f"{_SHARE_TEXT} as t0")
    return texts.selectExpr("event_id", f"{shares.parse_share('t0')} as f").selectExpr(
        "event_id", "cast(f.n as bigint) as n", "cast(f.d as bigint) as d"
    )


@query(f"""WITH {_SHARES}, g AS (SELECT *, n * bd + bn * d AS sn, n * bd - bn * d AS mn, d * bd AS sd FROM f WHERE d IS NOT NULL)
SELECT event_id, CASE WHEN sd // gcd(sn, sd) = 1 THEN CAST(sn // gcd(sn, sd) AS VARCHAR) ELSE CAST(sn // gcd(sn, sd) AS VARCHAR) || '/' || CAST(sd // gcd(sn, sd) AS VARCHAR) END AS total,
  CAST(sign(mn) AS BIGINT) AS sign, abs(mn) // greatest(gcd(mn, sd), 1) AS difference_n FROM g""")
def fraction_ops(spark, sf):
    texts = views.base(spark, sf, "events").selectExpr("event_id", f"{_SHARE_TEXT} as t0")
    pairs = texts.selectExpr(
        "event_id", f"{shares.parse_share('t0')} as x",
        shares.reduced("(event_id % 7 + 1)", "(event_id % 11 + 2)") + " as y",
    ).filter("x is not null")
    total, less = shares.share_sum("x", "y"), shares.share_difference("x", "y")
    return pairs.selectExpr("event_id", f"{total} as total", f"{shares.share_sign('x', 'y')} as sign", f"{less} as less").selectExpr(
        "event_id", f"{shares.share_text('total')} as total", "sign", "cast(abs(less.n) as bigint) as difference_n"
    )


# --- orders --------------------------------------------------------------

ORD = oracle_with("v_orders")
_READ = """CASE WHEN lower(mutation_type) LIKE 'sale%' THEN 'SALE' WHEN lower(mutation_type) LIKE 'gift%' THEN 'GIFT'
  WHEN lower(mutation_type) LIKE 'inheritance%' THEN 'INHERITANCE' END"""
_WHEN = "CAST(try_strptime(order_date, '%d/%m/%Y') AS DATE)"
_PART = "CASE share WHEN 'whole' THEN '1' WHEN '0.5' THEN '1/2' WHEN '1/2' THEN '1/2' END"


@query(f"{ORD} SELECT document_id, {_READ} AS kind FROM v_orders")
def parse_mutation_type(spark, sf):
    return views.order_readings(spark, sf).selectExpr("document_id", f"{order_words.parse_mutation_type('mutation_type')} as kind")


@query(f"{ORD} SELECT document_id, CAST({_WHEN} AS VARCHAR) AS day FROM v_orders")
def parse_order_date(spark, sf):
    return views.order_readings(spark, sf).selectExpr("document_id", f"{order_words.parse_order_date('order_date')} as day")


@query(f"{ORD} SELECT document_id, {_PART} AS share FROM v_orders")
def normalise_share(spark, sf):
    return views.order_readings(spark, sf).selectExpr("document_id", f"{shares.normalised_share('share')} as share")


ORDER_UNSURE = " + ".join(
    f"CAST({f} IS NOT NULL AND ((conf_seed_pct + {i * 7}) % 60 + 40)::DOUBLE / 100.0::DOUBLE < 0.75 AS BIGINT)"
    for i, f in enumerate(fixed.ORDER_FIELDS)
)
_MISSING = " + ".join(f"CAST({f} IS NULL AS BIGINT)" for f in fixed.REQUIRED_ORDER_FIELDS)


PREVIEW = f"""{STANDING.replace(MUT, oracle_with('v_mutations', 'v_orders'))},
read_orders AS (SELECT *, {_READ} AS kind_read, {_WHEN} AS day_read, {_PART} AS share_read, {place('village')} AS vk, {place('district')} AS dk FROM v_orders),
kp AS (SELECT *, {place('village')} AS vk, {place('district')} AS dk FROM v_parcels), pl AS (SELECT DISTINCT vk, dk FROM kp),
pp AS (SELECT a.vk AS va, a.dk AS da, b.vk AS vb, b.dk AS db FROM pl a, pl b WHERE {sim('a.vk', 'b.vk')} >= 0.85 AND {sim('a.dk', 'b.dk')} >= 0.85),
placed AS (SELECT o.document_id, min(p.parcel_id) AS of_parcel FROM read_orders o JOIN pp ON o.vk = va AND o.dk = da
  JOIN kp p ON p.khasra_number = o.khasra_number AND p.vk = vb AND p.dk = db GROUP BY o.document_id),
latest AS (SELECT parcel_id, max(effective_date) AS latest FROM standing GROUP BY parcel_id)"""


_CANDIDATE = "kind_read IS NOT NULL AND day_read IS NOT NULL AND share_read IS NOT NULL AND to_owner IS NOT NULL"
# Every order as the last entry of a register of its own, replayed whole; what the register has without it is taken off.
_ADDED = f"""{PREVIEW}, last_places AS (SELECT parcel_id, max(seq) AS last_seq FROM v_mutations GROUP BY parcel_id),
proposed AS (SELECT document_id, of_parcel, coalesce(last_seq, 0) + 1 AS seq, kind_read AS type, from_owner, to_owner, share_read AS share, mutation_number, day_read
  FROM read_orders LEFT JOIN placed USING (document_id) LEFT JOIN last_places ON last_places.parcel_id = of_parcel WHERE {_CANDIDATE}),
apart AS (SELECT p.document_id AS parcel_id, s.id, s.seq, s.type, s.from_owner, s.to_owner, s.share, s.mutation_number, s.effective_date FROM proposed p JOIN standing s ON s.parcel_id = p.of_parcel
  UNION ALL SELECT document_id, -1, seq, type, from_owner, to_owner, share, mutation_number, day_read FROM proposed),
{replay_of('standing')}, {replay_of('apart', 'with_')},
added AS (SELECT w.parcel_id AS document_id, 3 AS phase, w.n, w.code FROM with_replay_found w JOIN proposed p ON p.document_id = w.parcel_id
  LEFT JOIN (SELECT DISTINCT parcel_id, seq, code, x FROM replay_found) f ON f.parcel_id = p.of_parcel AND f.code = w.code AND coalesce(f.seq, -1) = coalesce(w.seq, -1) AND f.x = w.x
  WHERE f.code IS NULL
  UNION ALL SELECT document_id, 1, 0, 'backdated' FROM proposed JOIN latest ON parcel_id = of_parcel WHERE day_read < latest
  UNION ALL SELECT document_id, 1, 1, 'futureDated' FROM proposed WHERE day_read > TIMESTAMP '{NOW}' + INTERVAL 1 DAY
  UNION ALL SELECT document_id, 2, 0, 'duplicateNumber' FROM proposed p WHERE EXISTS (SELECT 1 FROM standing s WHERE s.parcel_id = p.of_parcel AND s.mutation_number = p.mutation_number))"""


@query(f"""{_ADDED}, chained AS (SELECT document_id, string_agg(replace(code, 'WholeTotal', 'Whole'), ',' ORDER BY phase, n) AS introduced,
  string_agg(code, ',' ORDER BY code NOT IN ({CRITICAL}), phase, n) AS chain_codes, count(*) FILTER (code IN ({CRITICAL})) AS defects, count(*) FILTER (code NOT IN ({CRITICAL})) AS warnings FROM added GROUP BY 1),
counted AS (SELECT document_id, {_MISSING} + CAST(kind_read IS NOT NULL AND from_owner IS NULL AS BIGINT) AS missing,
  CAST(kind_read IS NULL AS BIGINT) + CAST(order_date IS NOT NULL AND day_read IS NULL AS BIGINT) + CAST(share_read IS NULL AS BIGINT) AS unreadable,
  {ORDER_UNSURE} AS unsure, {_CANDIDATE} AS is_candidate FROM read_orders)
SELECT document_id, of_parcel AS parcel_id, is_candidate, coalesce(introduced, '') AS introduced, coalesce(chain_codes, '') AS chain_codes,
  repeat('chainDefect,', coalesce(defects, 0)) || repeat('chainWarning,', coalesce(warnings, 0)) || repeat('missing,', missing) || repeat('range,', unreadable) || repeat('confidence,', unsure) AS kinds,
  CASE WHEN coalesce(defects, 0) + coalesce(warnings, 0) + missing + unreadable + unsure > 0 THEN 'FLAGGED' ELSE 'PASS' END AS order_status
FROM counted LEFT JOIN placed USING (document_id) LEFT JOIN chained USING (document_id)""")
def order_preview(spark, sf):
    made = views.made_once(spark, sf)
    checked = orders.order_preview(views.order_readings(spark, sf, made), made["v_parcels"], made["v_mutations"], NOW)
    chained = "filter(issues, i -> i.kind in ('chainDefect', 'chainWarning'))"
    return checked.selectExpr(
        "document_id", "parcel_id", "is_candidate", "array_join(introduced, ',') as introduced",
        f"array_join(transform({chained}, i -> i.code), ',') as chain_codes",
        "array_join(transform(issues, i -> i.kind || ','), '') as kinds", "order_status",
    )


@query(f"""{_ADDED} SELECT p.document_id, p.of_parcel AS parcel_id, w.seq, w.code FROM with_replay_found w JOIN proposed p ON p.document_id = w.parcel_id
  LEFT JOIN (SELECT DISTINCT parcel_id, seq, code, x FROM replay_found) f ON f.parcel_id = p.of_parcel AND f.code = w.code AND coalesce(f.seq, -1) = coalesce(w.seq, -1) AND f.x = w.x
WHERE f.code IS NULL""")
def introduced_findings(spark, sf):
    made = views.made_once(spark, sf)
    registers = made["v_mutations"]
    placed = orders.placed_orders(views.order_readings(spark, sf, made), made["v_parcels"])
    proposed = stored(orders.proposed_entries(placed, registers))
    standing = stored(chain.standing_entries(registers))
    replayed = stored(chain.forked_replay(standing, proposed))
    after = replayed.filter("row_kind = 'fork'").select("document_id", "parcel_id", "seq", "kind", "code", "issue")
    return orders.introduced_findings(chain.replay_findings(replayed), after, ["parcel_id"]).select("document_id", "parcel_id", "seq", "code")


@query(f"""{ORD}, turns AS (SELECT document_id, parcel_id, row_number() OVER (PARTITION BY parcel_id // 16 ORDER BY document_id) AS turn FROM v_orders),
last AS (SELECT parcel_id // 16 AS g, max(seq) AS last_seq FROM v_mutations GROUP BY 1)
SELECT document_id, last_seq + turn AS seq FROM turns JOIN last ON g = parcel_id // 16""")
def register_position(spark, sf):
    # Sixteen registers share one here, so that several orders arrive at each.
    arrivals = views.order_readings(spark, sf).selectExpr(
        "(document_id - 7) div 128 as parcel_id", "document_id",
        "timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, document_id % 128) as arrived",
    )
    registers = views.mutations(spark, sf).selectExpr("parcel_id div 16 as parcel_id", "seq")
    return orders.register_position(registers, arrivals).selectExpr("document_id", "cast(seq as bigint) as seq")


_READABLE = f"{_READ} IS NOT NULL AND {_WHEN} IS NOT NULL AND {_PART} IS NOT NULL AND to_owner IS NOT NULL"


DECISIONS = f"""{PREVIEW}, d AS (SELECT *, CASE WHEN document_id % 50 = 7 THEN 'ALREADY_ENTERED' WHEN document_id % 3 = 0 THEN 'REJECTED'
  WHEN {_READABLE} THEN 'ENTERED' ELSE 'REFUSED' END AS outcome FROM read_orders LEFT JOIN placed USING (document_id)),
last_places AS (SELECT parcel_id, max(seq) AS last_seq FROM v_mutations GROUP BY parcel_id),
decided AS (SELECT d.*, CASE WHEN outcome = 'ENTERED' THEN coalesce(last_seq, 0) + row_number() OVER (PARTITION BY outcome, of_parcel ORDER BY document_id % 40, document_id) END AS seq
  FROM d LEFT JOIN last_places l ON l.parcel_id = of_parcel)"""


@query(f"""{DECISIONS} SELECT document_id, outcome, CASE outcome WHEN 'ENTERED' THEN 'VERIFIED' WHEN 'REJECTED' THEN 'REJECTED' END AS status, seq,
  CASE WHEN outcome = 'ENTERED' THEN of_parcel END AS parcel_id, CASE WHEN outcome = 'ENTERED' THEN kind_read END AS type, CASE WHEN outcome = 'ENTERED' THEN from_owner END AS from_owner,
  CASE WHEN outcome = 'ENTERED' THEN to_owner END AS to_owner, CASE WHEN outcome = 'ENTERED' THEN share_read END AS share, CASE WHEN outcome = 'ENTERED' THEN mutation_number END AS mutation_number,
  CASE WHEN outcome = 'ENTERED' THEN CAST(day_read AS VARCHAR) END AS effective_date, CASE WHEN outcome = 'ENTERED' THEN deed_number END AS order_reference FROM decided""")
def order_decisions(spark, sf):
    return decided_orders(spark, sf)


def decided_orders(spark, sf):
    """Two orders in three are approved, and one in fifty is in the register already."""
    decided = views.order_readings(spark, sf).selectExpr(
        "*", "if(document_id % 3 = 0, 'reject', 'approve') as action",
        "timestamp'2026-01-01' + make_interval(0, 0, 0, cast(document_id % 40 as int)) as arrived",
        "document_id % 50 = 7 as entered",
    )
    return orders.order_decisions(decided, views.parcels(spark, sf), views.mutations(spark, sf))


# --- audit ---------------------------------------------------------------

def events_as_entries(spark, sf):
    return views.base(spark, sf, "events").selectExpr(
        "user_id as document_id", "event_id as entry_id", "concat('u', event_id % 7) as actor_id",
        "event_type as action", "cast(null as string) as before", "props as after", "ts as timestamp",
    )


_ENTRIES = """WITH RECURSIVE e AS (SELECT user_id AS document_id, event_id AS entry_id, 'u' || event_id % 7 AS actor_id, event_type AS action, props, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
c AS (SELECT *, '{"action":"' || action || '","actorId":"' || actor_id || '","after":' || replace(props, ': ', ':') || ',"before":null,"documentId":"' || document_id || '","prev":' AS head,
  ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}' AS tail FROM e),
chain AS (SELECT document_id, entry_id, seq, sha256(head || 'null' || tail) AS hash, CAST(NULL AS VARCHAR) AS prev_hash FROM c WHERE seq = 0
  UNION ALL SELECT c.document_id, c.entry_id, c.seq, sha256(c.head || '"' || chain.hash || '"' || c.tail), chain.hash FROM chain JOIN c ON c.document_id = chain.document_id AND c.seq = chain.seq + 1)"""


@query(f"{_ENTRIES} SELECT document_id, entry_id, seq, hash, prev_hash FROM chain")
def audit_append(spark, sf):
    return audit.audit_append(events_as_entries(spark, sf)).select("document_id", "entry_id", "seq", "hash", "prev_hash")


@query("SELECT user_id AS document_id, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def audit_numbering(spark, sf):
    return audit.audit_numbering(events_as_entries(spark, sf)).select("document_id", "entry_id", "seq")


@query("""SELECT event_id AS entry_id, '{"action":"' || event_type || '","after":' || replace(props, ': ', ':') || '}' AS content FROM events""")
def canonical_json(spark, sf):
    packed = events_as_entries(spark, sf).selectExpr("entry_id", "concat('{\"after\": ', after, ' ,  \"action\": \"', action, '\"}') as j")
    return packed.selectExpr("entry_id", f"{audit.canonical_json('j')} as content")


@query("""SELECT event_id AS entry_id, sha256('{"action":"' || event_type || '","actorId":"u' || event_id % 7 || '","after":' || replace(props, ': ', ':') || ',"before":null,"documentId":"' || user_id || '","prev":null,"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}') AS hash FROM events""")
def entry_hash(spark, sf):
    return events_as_entries(spark, sf).selectExpr("entry_id", f"{audit.entry_hash('cast(null as string)')} as hash")


def tampered(stored):
    """A stored trail with altered, unhashed and removed entries."""
    return stored.filter("entry_id % 1999 <> 0").withColumns({
        "action": F.expr("if(entry_id % 997 = 0, 'changed', action)"),
        "hash": F.expr("if(entry_id % 1499 = 0, null, hash)"),
    })


_TAMPERED = f"""{_ENTRIES}, kept AS (SELECT chain.*, entry_id % 997 = 0 AS altered FROM chain WHERE entry_id % 1999 <> 0),
seen AS (SELECT document_id, entry_id, seq, altered, CASE WHEN entry_id % 1499 = 0 THEN NULL ELSE hash END AS stored, prev_hash FROM kept),
linked AS (SELECT *, lag(stored) OVER (PARTITION BY document_id ORDER BY seq) AS expected FROM seen),
faults AS (SELECT *, CASE WHEN stored IS NULL THEN 'unhashed' WHEN prev_hash IS DISTINCT FROM expected THEN 'unlinked' WHEN altered THEN 'altered' END AS reason FROM linked),
verified AS (SELECT document_id, count(*) AS entries, count(reason) = 0 AS intact, min(seq) FILTER (reason IS NOT NULL) AS broken_at,
  arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, CASE WHEN count(reason) = 0 THEN arg_max(stored, seq) ELSE arg_min(coalesce(expected, ''), seq) FILTER (reason IS NOT NULL) END AS head
  FROM faults GROUP BY document_id)"""


@query(f"{_TAMPERED} SELECT document_id, entries, intact, broken_at, reason, nullif(head, '') AS head FROM verified")
def audit_verify(spark, sf):
    return audit.audit_verify(tampered(audit.audit_append(events_as_entries(spark, sf))))


@query("""SELECT user_id AS document_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS approved_at, 'u' || arg_max(event_id, ts) % 7 AS approved_by
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def latest_approval(spark, sf):
    approved = events_as_entries(spark, sf).filter("action = 'purchase'").withColumn("action", F.lit("APPROVE"))
    return audit.latest_approval(approved)


@query(f"""{_TAMPERED}, records AS (SELECT DISTINCT user_id AS document_id, 'UP' || upper(substr(sha256(CAST(user_id AS VARCHAR)), 1, 12)) AS ulpin FROM events),
asked AS (SELECT ulpin AS reference FROM records UNION ALL SELECT 'UP' || user_id FROM events UNION ALL SELECT 'MH' || lpad(CAST(event_id AS VARCHAR), 12, 'Z') FROM events)
SELECT reference, CASE WHEN NOT regexp_full_match(reference, '[A-Z0-9]{{14}}') THEN 'badFormat' WHEN r.document_id IS NULL THEN 'notFound' ELSE 'found' END AS result,
  intact, entries FROM asked LEFT JOIN records r ON r.ulpin = reference LEFT JOIN verified v ON v.document_id = r.document_id""")
def record_check(spark, sf):
    entries = events_as_entries(spark, sf)
    trail = tampered(audit.audit_append(entries))
    records = entries.select("document_id").distinct().selectExpr(
        "document_id", f"{decisions.reference_id('document_id')} as ulpin", "'VERIFIED' as status"
    )
    asked = (
        records.selectExpr("ulpin as reference")
        .unionByName(entries.selectExpr("concat('UP', document_id) as reference"))
        .unionByName(entries.selectExpr("concat('MH', lpad(cast(entry_id as string), 12, 'Z')) as reference"))
    )
    return audit.record_check(asked, records, trail).select("reference", "result", "intact", "entries")


# --- limiter -------------------------------------------------------------

_LIMIT, _WINDOW = 3, 6 * 3600 * 1000


@query(f"""WITH RECURSIVE t AS (SELECT CAST(user_id AS VARCHAR) AS caller, event_id AS request_id, (epoch_us(ts) // 1000) AS at_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
w AS (SELECT caller, request_id, at_ms, n, at_ms AS start, 1 AS used, true AS allowed FROM t WHERE n = 1
  UNION ALL SELECT t.caller, t.request_id, t.at_ms, t.n, CASE WHEN t.at_ms - w.start >= {_WINDOW} THEN t.at_ms ELSE w.start END,
    CASE WHEN t.at_ms - w.start >= {_WINDOW} THEN 1 WHEN w.used >= {_LIMIT} THEN w.used ELSE w.used + 1 END,
    t.at_ms - w.start >= {_WINDOW} OR w.used < {_LIMIT} FROM w JOIN t ON t.caller = w.caller AND t.n = w.n + 1)
SELECT caller, request_id, at_ms, allowed FROM w""")
def request_limiter(spark, sf):
    requests = views.base(spark, sf, "events").selectExpr("cast(user_id as string) as caller", "event_id as request_id", "ts as at")
    return limiter.request_limiter(requests, _LIMIT, _WINDOW)
