"""The tool-call tasks: each template finds its entities in the state tables and writes the calls that solve the task.

Every eligible entity gives a task. Templates with a fixed number of calls return one row for each task, `calls` being a
JSON list in order. Bulk templates return one row for each call: a group may be of any size and is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.analytics import oracle, run_sql

# Fixed values.
SEAT_LIMITS = {"free": 3, "starter": 10, "pro": 40, "enterprise": None}
AGENTS = ("dana", "eli", "fatima", "gus", "hana", "ivo")
RESOLUTIONS = ("resolved", "wont_fix", "duplicate")
SUSPEND_REASONS = ("nonpayment", "abuse", "requested")
MAX_SEATS_PER_CALL = 10


def pick(key: str, values: tuple[str, ...]) -> str:
    """One of the values by a key, as SQL."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def call(tool: str, **args: str) -> str:
    """Canonical JSON of a call, as SQL. A value is an SQL expression; one of a text is written with a leading $. Braces go in by number, as those
    of a query stand for tables."""
    parts = [f"'\"{k}\":\"', {v[1:]}, '\"'" if v.startswith("$") else f"'\"{k}\":', CAST({v} AS STRING)" for k, v in sorted(args.items())]
    return "concat(chr(123), '\"args\":', chr(123), " + ", ',', ".join(parts) + f", chr(125), ',\"tool\":\"{tool}\"', chr(125))"


def listed(*calls: str) -> str:
    return "concat('[', " + ", ',', ".join(calls) + ", ']')"


LIMIT = "CASE plan WHEN 'free' THEN 3 WHEN 'starter' THEN 10 WHEN 'pro' THEN 40 ELSE 1000000 END"
ACC = f"""(SELECT *, seat_limit - seats AS room FROM (SELECT *, {LIMIT} AS seat_limit FROM (SELECT c_custkey AS account_id, n_name AS country, c_mktsegment AS industry,
    concat('Company ', c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 WHEN c_custkey % 30 = 2 THEN 2 ELSE 0 END) AS name,
    CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' ELSE 'enterprise' END AS plan,
    CASE c_custkey % 4 WHEN 0 THEN 1 + c_custkey % 3 WHEN 1 THEN 1 + c_custkey % 10 WHEN 2 THEN 4 + c_custkey % 37 ELSE 20 + c_custkey % 80 END AS seats,
    CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_acctbal < 5000 THEN 'active' ELSE 'trial' END AS status FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) a0) a1)"""
USERS = "(SELECT DISTINCT user_id, user_id % 60 AS account_id, concat('u', user_id, '@x.org') AS email, CASE WHEN user_id < 60 THEN 'owner' ELSE 'member' END AS role FROM {events})"
TAKEN = f"(SELECT account_id, count(*) AS taken FROM {USERS} u0 GROUP BY account_id)"
FREE = f"(SELECT a.*, coalesce(t.taken, 0) AS taken, a.seats - coalesce(t.taken, 0) AS free_seats FROM {ACC} a LEFT JOIN {TAKEN} t ON t.account_id = a.account_id)"
INV = "(SELECT o_orderkey AS invoice_id, o_custkey AS account_id, CASE WHEN o_orderkey % 33 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_cents, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'overdue' END ELSE 'void' END AS status FROM {orders})"
TIX = f"(SELECT event_id AS ticket_id, user_id % 150 AS account_id, CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'pending' WHEN 3 THEN 'pending' ELSE 'closed' END AS status, CASE WHEN event_id % 5 >= 2 THEN {pick('event_id', AGENTS)} END AS assignee, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, event_type AS category FROM {{events}} WHERE event_type IN ('error', 'click'))"

CAN_CHANGE = "status IN ('active', 'trial')"
REFUNDABLE = "status = 'paid' AND amount_cents IS NOT NULL"
NEW_AGENT = pick("(ticket_id + 1)", AGENTS)
ASSIGN = call("assign_ticket", ticket_id="ticket_id", agent=f"${NEW_AGENT}")
CLOSE = call("close_ticket", ticket_id="ticket_id", resolution=f"${pick('ticket_id', RESOLUTIONS)}")
REFUND = call("refund_invoice", invoice_id="invoice_id")
SUSPEND = call("suspend_account", account_id="account_id", reason=f"${pick('account_id', SUSPEND_REASONS)}")
#: The smallest other tier that the seats fit.
FIT_TIER = "CASE WHEN seats <= 3 AND plan <> 'free' THEN 'free' WHEN seats <= 10 AND plan <> 'starter' THEN 'starter' WHEN seats <= 40 AND plan <> 'pro' THEN 'pro' WHEN plan <> 'enterprise' THEN 'enterprise' END"
MOVE = call("update_plan", account_id="account_id", plan="$target")


def seats(n: str) -> str:
    return call("add_seat", account_id="account_id", count=n)


def user(k: int = 1) -> str:
    return call("create_user", account_id="account_id", email=f"$concat('new{k}-', account_id, '@x.org')", full_name=f"$'New Person {k}'", role="$'member'")


T: dict[str, str] = {}


def each(name: str, key: str, calls: str | tuple[str, ...], source: str, where: str = "TRUE") -> None:
    """A row for each task: its key and the JSON list of its calls. Text in place of calls is SQL for the whole list."""
    T[name] = f"SELECT {key} AS task_key, {calls if isinstance(calls, str) else listed(*calls)} AS calls FROM {source} s WHERE {where}"


def bulk(name: str, key: str, one: str, source: str, where: str, having: str) -> None:
    """A row for each call of the groups that `having` keeps; groups are counted, not gathered."""
    rows = f"(SELECT * FROM {source} s WHERE {where})"
    T[name] = f"SELECT r.{key} AS task_key, {one} AS call FROM {rows} r WHERE EXISTS (SELECT 1 FROM (SELECT {key} FROM {rows} g GROUP BY {key} HAVING {having}) k WHERE k.{key} = r.{key})"


def when(*cases: tuple[str, str]) -> str:
    """The list for the first case that holds, else no call."""
    return "CASE " + " ".join(f"WHEN {c} THEN {listed(x)}" for c, x in cases) + " ELSE '[]' END"


def alone(source: str, keys: str, where: str) -> str:
    """Rows of groups with exactly one row: the least id of the group is then that row's, so no window is needed."""
    return f"(SELECT {keys}, min(ticket_id) AS ticket_id FROM {source} s WHERE {where} GROUP BY {keys} HAVING count(*) = 1)"


#: The one largest paid invoice of each account; accounts whose largest amount occurs twice have none.
LARGEST = f"(SELECT i.account_id, min(i.invoice_id) AS invoice_id FROM {INV} i JOIN (SELECT account_id, max(amount_cents) AS top FROM {INV} j WHERE {REFUNDABLE} GROUP BY account_id) m ON m.account_id = i.account_id AND m.top = i.amount_cents WHERE i.status = 'paid' GROUP BY i.account_id HAVING count(*) = 1)"
NAMED = f"(SELECT a.* FROM {ACC} a JOIN (SELECT name, country FROM {ACC} b GROUP BY name, country HAVING count(*) = 1) u ON u.name = a.name AND u.country = a.country)"
TARGETED = f"(SELECT *, {FIT_TIER} AS target FROM {{}} q)"
BATCH = f"least(room, {MAX_SEATS_PER_CALL})"

# one call
each("sc_refund", "invoice_id", (REFUND,), INV, REFUNDABLE)
each("sc_close", "ticket_id", (CLOSE,), TIX, "status = 'pending' AND assignee IS NOT NULL")
each("sc_assign", "ticket_id", (ASSIGN,), TIX, f"status <> 'closed' AND (assignee IS NULL OR assignee <> {NEW_AGENT})")
each("sc_suspend", "account_id", (SUSPEND,), ACC, CAN_CHANGE)
each("sc_add_seat", "account_id", (seats(BATCH),), ACC, f"{CAN_CHANGE} AND plan <> 'free' AND room > 0")
each("sc_update_plan", "account_id", (MOVE,), TARGETED.format(ACC), f"{CAN_CHANGE} AND target IS NOT NULL")
each("sc_create_user", "account_id", (user(),), FREE, f"{CAN_CHANGE} AND free_seats > 0")
# a lookup first
each("la_refund_largest", "account_id", (call("lookup_account", account_id="account_id"), REFUND), LARGEST)
each("la_close_ticket", "ticket_id", (call("lookup_ticket", ticket_id="ticket_id"), CLOSE), alone(TIX, "account_id, priority", "status = 'pending'"))
each("la_assign_open", "ticket_id", (call("lookup_ticket", ticket_id="ticket_id"), ASSIGN), alone(TIX, "account_id, category", "status = 'open'"))
each("la_suspend_by_name", "account_id", (call("lookup_account", account_id="account_id"), SUSPEND), NAMED, CAN_CHANGE)
each("la_user_by_owner", "account_id", (call("lookup_user", email="$owner"), user()), f"(SELECT f.*, o.email AS owner FROM {FREE} f JOIN {USERS} o ON o.account_id = f.account_id AND o.role = 'owner')", f"{CAN_CHANGE} AND free_seats > 0")
each("la_plan_by_name", "account_id", (call("lookup_account", account_id="account_id"), MOVE), TARGETED.format(NAMED), f"{CAN_CHANGE} AND target IS NOT NULL")
# several steps
each("ms_assign_close", "ticket_id", (ASSIGN, CLOSE), TIX, "status = 'open'")
each("ms_reassign_close", "ticket_id", (ASSIGN, CLOSE), TIX, f"status = 'pending' AND assignee <> {NEW_AGENT}")
each("ms_seat_then_user", "account_id", (seats("1"), user()), FREE, f"{CAN_CHANGE} AND plan <> 'free' AND room > 0 AND free_seats = 0")
each("ms_upgrade_then_seats", "account_id", (call("update_plan", account_id="account_id", plan="$'pro'"), seats("10 - seats + 1")), ACC, f"{CAN_CHANGE} AND plan = 'starter'")
each("ms_refund_suspend", "invoice_id", (REFUND, SUSPEND), f"(SELECT i.invoice_id, i.amount_cents, i.status AS paid, a.account_id, a.status FROM {INV} i JOIN {ACC} a ON a.account_id = i.account_id)", f"paid = 'paid' AND amount_cents IS NOT NULL AND {CAN_CHANGE}")
# conditions on the state
each("cd_plan", "account_id", when(("plan = 'free'", call("update_plan", account_id="account_id", plan="$'starter'")), ("plan <> 'free' AND room > 0", seats("1"))), ACC, CAN_CHANGE)
each("cd_ticket", "ticket_id", when(("status = 'open'", ASSIGN), ("status = 'pending'", CLOSE)), TIX)
each("cd_invoice", "invoice_id", when((REFUNDABLE, REFUND)), INV)
each("cd_status", "account_id", when(("status = 'trial' AND plan = 'free'", SUSPEND), ("status = 'trial'", call("update_plan", account_id="account_id", plan="$CASE plan WHEN 'enterprise' THEN CASE WHEN seats <= 40 THEN 'pro' ELSE 'enterprise' END ELSE 'enterprise' END")), ("status = 'active' AND plan <> 'free' AND room > 0", seats("1"))), ACC, "NOT (status = 'trial' AND plan = 'enterprise' AND seats > 40)")
# whole groups
bulk("bk_refund", "account_id", REFUND, INV, REFUNDABLE, "count(*) >= 2")
bulk("bk_close", "account_id", CLOSE, TIX, "status = 'pending'", "count(*) >= 2")
bulk("bk_assign", "account_id", ASSIGN, TIX, "status = 'open'", "count(*) >= 2")
bulk("bk_priority", "cell", ASSIGN, f"(SELECT *, concat(category, '/', priority, '/', account_id) AS cell FROM {TIX} t)", "status = 'open'", "count(*) BETWEEN 2 AND 5")
each("bk_users", "account_id", (user(1), user(2), user(3)), FREE, f"{CAN_CHANGE} AND free_seats >= 3")
# guards: an empty list where the state forbids the action
each("eg_refund", "invoice_id", when((REFUNDABLE, REFUND)), INV, "status IN ('paid', 'void')")
each("eg_close", "ticket_id", when(("status <> 'closed' AND assignee IS NOT NULL", CLOSE)), TIX)
each("eg_suspend", "account_id", when((CAN_CHANGE, SUSPEND)), ACC)
each("eg_seats", "account_id", when((f"{CAN_CHANGE} AND plan <> 'free' AND room >= 5", seats("5"))), ACC)
each("eg_user", "account_id", when((f"{CAN_CHANGE} AND free_seats > 0", user())), FREE)
# chains
each("dc_onboard", "account_id", (seats("2"), user(1), user(2)), FREE, f"{CAN_CHANGE} AND plan <> 'free' AND room >= 2 AND free_seats BETWEEN 0 AND 1")
each("dc_free_full", "account_id", (call("update_plan", account_id="account_id", plan="$'starter'"), seats("1"), user()), FREE, f"{CAN_CHANGE} AND plan = 'free' AND free_seats <= 0 AND taken <= seats")
each("dc_ticket_pair", "account_id", (call("assign_ticket", ticket_id="first_id", agent="$'dana'"), call("assign_ticket", ticket_id="second_id", agent="$'eli'"), call("close_ticket", ticket_id="first_id", resolution="$'duplicate'")),
     f"(SELECT f.account_id, f.first_id, min(t.ticket_id) AS second_id FROM (SELECT account_id, min(ticket_id) AS first_id FROM {TIX} o WHERE status = 'open' GROUP BY account_id) f JOIN {TIX} t ON t.account_id = f.account_id AND t.status = 'open' AND t.ticket_id > f.first_id GROUP BY f.account_id, f.first_id)")
# across entities
each("ce_dup_names", "low", (call("suspend_account", account_id="high", reason="$'requested'"),), f"(SELECT name, min(account_id) AS low, max(account_id) AS high, max(CASE WHEN {CAN_CHANGE} THEN account_id END) AS able FROM {ACC} a GROUP BY name HAVING count(*) = 2)", "able = high")
each("ce_industry_overdue", "account_id", (SUSPEND,), ACC, f"{CAN_CHANGE} AND account_id IN (SELECT account_id FROM {INV} i WHERE i.status = 'overdue')")
bulk("ce_tier_seats", "cell", seats("1"), f"(SELECT *, concat(plan, '/', country, '/', industry) AS cell FROM {ACC} a)", f"{CAN_CHANGE} AND plan <> 'free' AND room > 0", "count(*) BETWEEN 1 AND 5")
each("ce_two_accounts", "account_id", (call("refund_invoice", invoice_id="invoice_id"), call("refund_invoice", invoice_id="other_id")), f"(SELECT a.account_id, a.invoice_id, b.invoice_id AS other_id FROM {LARGEST} a JOIN {LARGEST} b ON b.account_id = a.account_id + 1)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, sql=sql: run_sql(spark, sf_dir, sql) for name, sql in T.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in T.items()}
