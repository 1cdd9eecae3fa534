"""Seeded tables of a SaaS business, of any size: each row is a function of (seed, table, number) alone.

Rows are made by Spark from a range, with hashes for chance, so they are the same at any number of partitions, no row needs another, and a
foreign key is the number of a row that exists. Dates that depend on a parent's are worked out from the parent's number, not by a join.
NULLs that trap queries are there: soft deletes, open ends, missing amounts, one-off invoices, tickets without user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
INDUSTRIES = ("fintech", "healthcare", "retail", "logistics", "education", "media", "energy")
COUNTRIES = ("US", "DE", "GB", "FR", "IN", "BR", "CA", "AU", "JP", "NL")
ACCOUNT_STATUSES = ("active", "trial", "churned", "suspended")
ROLES = ("owner", "admin", "member", "viewer")
TIERS = (("free", 0, 3), ("starter", 2900, 10), ("pro", 9900, 40), ("enterprise", 49900, None))
SUBSCRIPTION_STATUSES = ("active", "cancelled", "past_due", "trialing")
INVOICE_STATUSES = ("paid", "open", "overdue", "void")
METHODS = ("card", "ach", "wire", "paypal")
PAYMENT_STATUSES = ("succeeded", "failed", "refunded")
PRIORITIES = ("low", "normal", "high", "urgent")
CATEGORIES = ("billing", "bug", "how_to", "feature_request", "account_access")
FEATURES = ("dashboards", "api", "exports", "sso", "automations", "audit_log")

#: Rows of each table at scale 1.
ROWS = {"plans": 8, "accounts": 120, "users": 700, "subscriptions": 260, "invoices": 1400, "payments": 1500, "support_tickets": 800, "feature_usage": 2400}
#: Those whose number of rows doesn't grow with the scale.
FIXED = ("plans",)
FIRST_DAY, DAYS = "2022-01-01", 900
WORDS = ("Amber", "Basalt", "Cedar", "Delta", "Ember", "Fjord", "Garnet", "Harbor", "Iris", "Juniper", "Krill", "Larch")


class Chance:
    """Draws for the row with a number of a table, by name."""

    def __init__(self, seed: int, table: str, number: Column) -> None:
        self.key = (F.lit(seed), F.lit(table), number.cast("long"))

    def below(self, what: str, n: int | Column) -> Column:
        """A whole number from 0 to n - 1."""
        return F.pmod(F.xxhash64(*self.key, F.lit(what)), F.lit(n) if isinstance(n, int) else n.cast("long")).cast("long")

    def one_of(self, what: str, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.below(what, len(values)) + 1).cast("int"))

    def often(self, what: str, percent: int) -> Column:
        return self.below(what, 100) < percent


def day(n: Column) -> Column:
    """The day number n, as ISO text."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")).cast("string")


def at(n: Column, second: Column) -> Column:
    return F.concat(day(n + F.floor(second / 86400)), F.lit(" "), F.lpad(F.floor(second % 86400 / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(second % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((second % 60).cast("string"), 2, "0"))


def n_rows(table: str, scale: int) -> int:
    return ROWS[table] * (1 if table in FIXED else scale)


def generate(spark: SparkSession, table: str, seed: int, scale: int = 1, partitions: int | None = None) -> DataFrame:
    """A table of n_rows(table, scale) rows with keys from 1."""
    if table not in ROWS:
        raise ValueError(f"no table {table}")
    if scale < 1:
        raise ValueError("the scale is 1 or more")
    key = F.col("id")
    c = Chance(seed, table, key)
    count = {t: n_rows(t, scale) for t in ROWS}
    created = lambda account: Chance(seed, "accounts", account).below("created", DAYS)
    opens = lambda subscription: Chance(seed, "subscriptions", subscription).below("start", DAYS)
    issued = lambda invoice: Chance(seed, "invoices", invoice).below("issued", DAYS)
    cents = lambda invoice: 1000 + Chance(seed, "invoices", invoice).below("cents", 490_000)
    status_of = lambda invoice: Chance(seed, "invoices", invoice).one_of("status", ("paid", "paid", "paid", *INVOICE_STATUSES))
    account_of = lambda t, number: 1 + Chance(seed, t, number).below("account", count["accounts"])
    some = lambda what, percent, value: F.when(c.often(what, percent), value)

    def plans() -> dict[str, Column]:
        tier = ((key - 1) % len(TIERS)).cast("int")
        pick = lambda i, kind: F.element_at(F.array(*[F.lit(t[i]).cast(kind) for t in TIERS]), tier + 1)
        return {"plan_id": key, "name": F.concat(F.initcap(pick(0, "string")), F.when(key <= len(TIERS), "").otherwise(" yearly")), "tier": pick(0, "string"), "monthly_price_cents": pick(1, "long"), "seat_limit": pick(2, "long")}

    def accounts() -> dict[str, Column]:
        # Every fifth bears the name of one of the fifty before it, as names aren't unique.
        named = F.when((key % 5 == 0) & (key > 50), key - 1 - c.below("same", 49)).otherwise(key)
        n = Chance(seed, "names", named)
        root = F.greatest(F.floor(key / 9), F.lit(1))
        return {
            "account_id": key, "name": F.concat(n.one_of("a", WORDS), F.lit(" "), n.one_of("b", WORDS), F.lit(" "), named.cast("string")), "industry": c.one_of("industry", INDUSTRIES), "country": c.one_of("country", COUNTRIES),
            "created_at": day(created(key)), "status": c.one_of("status", ("active", "active", "active", *ACCOUNT_STATUSES)), "deleted_at": some("deleted", 8, day(created(key) + 30 + c.below("gone", 300))),
            "parent_account_id": F.when((key > 9) & c.often("child", 20), root), "sales_rep": some("rep", 70, F.concat(F.lit("rep-"), c.below("who", 12).cast("string"))),
        }

    def users() -> dict[str, Column]:
        joined = created(account_of("users", key)) + c.below("joined", 200)
        return {
            "user_id": key, "account_id": account_of("users", key), "email": F.concat(F.lit("user"), key.cast("string"), F.lit("@example.org")), "full_name": F.concat(c.one_of("first", WORDS), F.lit(" "), c.one_of("last", WORDS)),
            "role": c.one_of("role", ROLES), "created_at": day(joined), "last_login_at": some("login", 80, at(joined + c.below("later", 200), c.below("second", 86_400))), "deleted_at": some("deleted", 7, day(joined + 250)),
        }

    def subscriptions() -> dict[str, Column]:
        status = c.one_of("status", ("active", "active", *SUBSCRIPTION_STATUSES))
        return {
            "subscription_id": key, "account_id": account_of("subscriptions", key), "plan_id": 1 + c.below("plan", count["plans"]), "start_date": day(opens(key)), "end_date": F.when(status == "cancelled", day(opens(key) + 30 + c.below("length", 300))),
            "status": status, "seats": 1 + c.below("seats", 60), "discount_pct": some("discount", 30, (c.below("pct", 8) * 5 + 5).cast("double")),
        }

    def invoices() -> dict[str, Column]:
        subscription = 1 + c.below("subscription", count["subscriptions"])
        one_off = c.often("one_off", 12)
        return {
            "invoice_id": key, "account_id": F.when(one_off, account_of("invoices", key)).otherwise(account_of("subscriptions", subscription)), "subscription_id": F.when(~one_off, subscription), "issued_date": day(issued(key)),
            "due_date": day(issued(key) + 14 + c.below("term", 3) * 8), "amount_cents": F.when(~c.often("missing", 4), cents(key)), "currency": c.one_of("currency", ("USD", "USD", "USD", "EUR")), "status": status_of(key),
        }

    def payments() -> dict[str, Column]:
        invoice = 1 + c.below("invoice", count["invoices"])
        method = c.one_of("method", METHODS)
        return {
            "payment_id": key, "invoice_id": invoice, "paid_at": day(issued(invoice) + c.below("after", 60)), "amount_cents": cents(invoice), "method": method, "status": c.one_of("status", ("succeeded", "succeeded", "succeeded", *PAYMENT_STATUSES)),
            "processor_ref": F.when(~(method.isin("ach", "wire") & c.often("no_ref", 60)), F.concat(F.lit("ref-"), F.hex(c.below("ref", 1 << 40)))),
        }

    def support_tickets() -> dict[str, Column]:
        # A ticket is its user's account's; one by mail has no user, and the same account.
        user = 1 + c.below("user", count["users"])
        opened, second = created(account_of("users", user)) + c.below("opened", 300), c.below("second", 86_400)
        status = c.one_of("status", ("closed", "closed", "closed", "open", "pending"))
        return {
            "ticket_id": key, "account_id": account_of("users", user), "user_id": F.when(~c.often("mail", 15), user), "opened_at": at(opened, second), "closed_at": F.when(status == "closed", at(opened, second + c.below("took", 20 * 86_400))),
            "priority": c.one_of("priority", PRIORITIES), "category": c.one_of("category", CATEGORIES), "status": status, "csat_score": F.when((status == "closed") & c.often("rated", 60), 1 + c.below("score", 5)),
        }

    def feature_usage() -> dict[str, Column]:
        user = 1 + c.below("user", count["users"])
        return {"usage_id": key, "user_id": user, "feature": c.one_of("feature", FEATURES), "used_on": day(created(account_of("users", user)) + c.below("used", 400)), "event_count": 1 + c.below("events", 40)}

    columns = {f.__name__: f for f in (plans, accounts, users, subscriptions, invoices, payments, support_tickets, feature_usage)}[table]()
    rows = spark.range(1, count[table] + 1, 1, partitions) if partitions else spark.range(1, count[table] + 1)
    return rows.select(*[expr.alias(name) for name, expr in columns.items()])


def tables(spark: SparkSession, seed: int, scale: int = 1) -> dict[str, DataFrame]:
    return {t: generate(spark, t, seed, scale) for t in ROWS}


def nested_state(made: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, fields): the state that tool calls change, of the tables, as entities with JSON fields: accounts with the plan and seats of their last
    subscription and the users that take them, users by e-mail, invoices, and tickets with an agent."""
    plan = made["subscriptions"].join(made["plans"].select("plan_id", "tier"), "plan_id").groupBy("account_id").agg(F.max_by(F.struct("tier", "seats"), F.struct("start_date", "subscription_id")).alias("p"))
    taken = made["users"].where("deleted_at IS NULL").groupBy("account_id").agg(F.count("*").alias("taken"))
    accounts = made["accounts"].join(plan, "account_id", "left").join(taken, "account_id", "left")
    entity = lambda df, kind, key, *fields: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("fields"))
    agents = F.when(F.col("status") != "open", F.element_at(F.array(*[F.lit(a) for a in ("dana", "eli", "fatima", "gus", "hana", "ivo")]), (F.col("ticket_id") % 6 + 1).cast("int")))
    return (
        entity(accounts, "account", "account_id", "status", F.coalesce("p.tier", F.lit("free")).alias("plan"), F.coalesce("p.seats", F.lit(1)).alias("seats"), F.coalesce("taken", F.lit(0)).alias("taken"))
        .unionByName(entity(made["users"], "user", "email", "account_id", "role"))
        .unionByName(entity(made["invoices"], "invoice", "invoice_id", "account_id", "status", "amount_cents"))
        .unionByName(entity(made["support_tickets"], "ticket", "ticket_id", "account_id", "status", agents.alias("assignee")))
    )
