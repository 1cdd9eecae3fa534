"""The analytical surface: parameterised queries in twelve families over SaaS-shaped views of the driver's tables.

Queries are SQL with named parameters (`:x`), bound by Spark, never pasted. Views are expanded as subqueries, so Catalyst
prunes columns and pushes filters through them; nothing is registered in a catalog. Dates are ISO strings that are
compared as strings, as impossible dates such as June 31 are legal bounds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations", "pages")

VIEWS = {
    "accounts": """SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS industry, n_name AS country, c_acctbal AS balance,
        CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_acctbal < 5000 THEN 'active' ELSE 'trial' END AS status, CAST(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INT) AS STRING) AS created_at,
        NULLIF(c_custkey % 7, 0) AS sales_rep, CASE WHEN c_custkey % 20 = 0 THEN '2024-06-01' END AS deleted_at, CASE WHEN c_custkey % 9 = 0 THEN CAST(floor(c_custkey / 9.0) AS BIGINT) END AS parent_account_id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "users": """SELECT DISTINCT user_id, user_id % 60 AS account_id, concat('u', user_id, '@x.org') AS email, CASE WHEN user_id % 5 = 0 THEN 'admin' WHEN user_id % 5 < 3 THEN 'member' ELSE 'viewer' END AS role,
        CASE WHEN user_id % 11 = 0 THEN '2024-01-15' END AS deleted_at, CASE WHEN user_id % 6 <> 0 THEN concat('2024-01-', lpad(CAST(user_id % 28 + 1 AS STRING), 2, '0')) END AS last_login_at FROM {events}""",
    "plans": "SELECT p_partkey AS plan_id, p_name AS name, p_brand AS tier, CAST(round(p_retailprice * 100) AS BIGINT) AS monthly_price_cents, p_size AS seat_limit FROM {part}",
    "subscriptions": """SELECT l_orderkey * 8 + l_linenumber AS subscription_id, o_custkey AS account_id, l_partkey AS plan_id, CAST(CAST(l_shipdate AS DATE) AS STRING) AS start_date,
        CASE WHEN l_returnflag <> 'N' THEN CAST(CAST(l_shipdate AS DATE) + 90 AS STRING) END AS end_date, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'ended' END AS status,
        CAST(l_quantity AS BIGINT) AS seats, NULLIF(l_discount, 0) AS discount_pct FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "invoices": """SELECT o_orderkey AS invoice_id, o_custkey AS account_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey * 8 + 1 END AS subscription_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS issued_date,
        CAST(CAST(o_orderdate AS DATE) + 30 AS STRING) AS due_date, CASE WHEN o_orderkey % 33 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_cents, o_orderpriority AS currency,
        CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'void' END AS status FROM {orders}""",
    "payments": """SELECT l_orderkey * 8 + l_linenumber AS payment_id, l_orderkey AS invoice_id, CAST(CAST(l_shipdate AS DATE) AS STRING) AS paid_at, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
        l_returnflag AS method, CASE WHEN l_linenumber % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM {lineitem}""",
    "tickets": """SELECT event_id AS ticket_id, user_id % 60 AS account_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id, ts AS opened_at,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL '5' HOUR WHEN 2 THEN ts + INTERVAL '40' HOUR ELSE ts + INTERVAL '100' HOUR END AS closed_at,
        CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, event_type AS category, CASE WHEN event_id % 4 = 0 THEN 'open' ELSE 'closed' END AS status,
        NULLIF(event_id % 6, 0) AS csat_score FROM {events} WHERE event_type IN ('error', 'click')""",
    "usage": "SELECT event_id AS usage_id, user_id, event_type AS feature, CAST(CAST(ts AS DATE) AS STRING) AS used_on, CAST(floor(value) AS BIGINT) AS event_count FROM {events}",
}

#: What the two dialects name differently: microseconds since the epoch, SHA-256, a field of a JSON text, the product of two vectors.
SPELLED = {
    "MICROS": {"spark": "unix_micros(CAST(\\1 AS TIMESTAMP))", "duckdb": "epoch_us(\\1)"},
    "SECONDS": {"spark": "unix_seconds(CAST(\\1 AS TIMESTAMP))", "duckdb": "CAST(floor(epoch(\\1)) AS BIGINT)"},
    "DIGITS": {"spark": "regexp_replace(\\1, '[0-9]+', '?')", "duckdb": "regexp_replace(\\1, '[0-9]+', '?', 'g')"},
    "HEX15": {"spark": "CAST(conv(\\1, 16, 10) AS DECIMAL(38, 0))", "duckdb": "CAST(concat('0x', \\1) AS HUGEINT)"},
    "SHA": {"spark": "sha2(\\1, 256)", "duckdb": "sha256(\\1)"},
    "FIELD_K": {"spark": "CAST(get_json_object(\\1, '$.k') AS BIGINT)", "duckdb": "CAST(json_extract_string(\\1, '$.k') AS BIGINT)"},
    "DOT": {"spark": "aggregate(zip_with(\\1, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, b) -> a + b)", "duckdb": "list_dot_product(CAST(list_extract([\\1], 1) AS DOUBLE[]), CAST(list_extract([\\1], 2) AS DOUBLE[]))"},
}

#: An argument with up to six levels of brackets.
ARGUMENT = r"[^()]"
for _ in range(6):
    ARGUMENT = rf"(?:[^()]|\({ARGUMENT}*\))"

Q: dict[str, tuple[str, dict]] = {}


def q(name: str, sql: str, **params: object) -> None:
    Q[name] = (" ".join(sql.split()), params)


# filter
q("accounts_by_country_status", "SELECT name FROM {accounts} WHERE country = :c AND status = :s", c="NATION_3", s="active")
q("users_by_role", "SELECT count(*) AS n FROM {users} WHERE role = :r", r="member")
q("invoices_over_amount", "SELECT invoice_id FROM {invoices} WHERE amount_cents > :x", x=30_000_000)
q("tickets_priority_category", "SELECT ticket_id FROM {tickets} WHERE priority = :p AND category = :c", p="high", c="error")
q("accounts_created_after", "SELECT name FROM {accounts} WHERE industry = :i AND created_at > :d", i="BUILDING", d="2022-01-01")
# join
q("active_subs_country", "SELECT a.name AS account_name, p.name AS plan_name FROM {accounts} a JOIN {subscriptions} s ON s.account_id = a.account_id JOIN {plans} p ON p.plan_id = s.plan_id WHERE a.country = :c AND s.status = 'active'", c="NATION_3")
q("tier_subscriptions", "SELECT s.subscription_id, a.name FROM {subscriptions} s JOIN {plans} p ON p.plan_id = s.plan_id JOIN {accounts} a ON a.account_id = s.account_id WHERE p.tier = :t AND a.status = 'active' AND s.seats > :n", t="Brand#1", n=20)
q("users_with_ticket_priority", "SELECT DISTINCT u.email FROM {users} u JOIN {tickets} t ON t.user_id = u.user_id WHERE t.priority = :p", p="high")
q("invoices_account_names", "SELECT i.invoice_id, a.name FROM {invoices} i JOIN {accounts} a ON a.account_id = i.account_id WHERE substring(i.issued_date, 1, 4) = :y AND i.status = 'void'", y="1997")
q("invoice_plan_account", "SELECT i.invoice_id, p.name AS plan_name, a.name AS account_name FROM {invoices} i JOIN {subscriptions} s ON s.subscription_id = i.subscription_id JOIN {plans} p ON p.plan_id = s.plan_id JOIN {accounts} a ON a.account_id = i.account_id WHERE i.status = :s AND a.country = :c AND s.seats > 10", s="paid", c="NATION_5")
q("ticket_user_account", "SELECT t.ticket_id, u.email, a.name FROM {tickets} t JOIN {users} u ON u.user_id = t.user_id JOIN {accounts} a ON a.account_id = u.account_id WHERE t.priority = :p", p="low")
q("payment_method_accounts", "SELECT p.payment_id, a.name FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id JOIN {accounts} a ON a.account_id = i.account_id WHERE p.method = :m AND p.paid_at BETWEEN :lo AND :hi", m="R", lo="1996-01-01", hi="1996-06-31")
q("child_parent_accounts", "SELECT c.name AS child, p.name AS parent FROM {accounts} c JOIN {accounts} p ON p.account_id = c.parent_account_id WHERE p.status = 'active'")
q("feature_users_accounts", "SELECT DISTINCT a.name FROM {usage} f JOIN {users} u ON u.user_id = f.user_id JOIN {accounts} a ON a.account_id = u.account_id WHERE f.feature = :f", f="purchase")
# aggregation
q("accounts_per_industry", "SELECT industry, count(*) AS n FROM {accounts} WHERE status = :s GROUP BY industry", s="active")
q("active_subs_per_plan", "SELECT p.tier, count(*) AS n FROM {subscriptions} s JOIN {plans} p ON p.plan_id = s.plan_id WHERE s.status = 'active' GROUP BY p.tier")
q("accounts_paid_over", "SELECT i.account_id, sum(p.amount_cents) AS total FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id WHERE p.status = 'succeeded' GROUP BY i.account_id HAVING sum(p.amount_cents) > :x", x=100_000_000)
q("avg_csat_category", "SELECT category, round(avg(csat_score), 2) AS csat FROM {tickets} GROUP BY category")
q("countries_many_accounts", "SELECT country, count(*) AS n FROM {accounts} GROUP BY country HAVING count(*) > :n", n=5)
q("revenue_by_tier", "SELECT pl.tier, sum(p.amount_cents) AS revenue FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id JOIN {subscriptions} s ON s.subscription_id = i.subscription_id JOIN {plans} pl ON pl.plan_id = s.plan_id WHERE p.status = 'succeeded' AND p.paid_at BETWEEN :lo AND :hi GROUP BY pl.tier", lo="1995-01-01", hi="2000-12-31")
q("accounts_many_tickets", "SELECT a.account_id, a.name, count(*) AS n FROM {tickets} t JOIN {accounts} a ON a.account_id = t.account_id GROUP BY a.account_id, a.name HAVING count(*) > :n", n=3)
q("usage_by_feature", "SELECT f.feature, sum(f.event_count) AS total FROM {usage} f JOIN {users} u ON u.user_id = f.user_id JOIN {accounts} a ON a.account_id = u.account_id WHERE a.status = 'active' GROUP BY f.feature")
q("avg_invoice_by_country", "SELECT a.country, round(avg(i.amount_cents), 2) AS mean, count(*) AS n FROM {invoices} i JOIN {accounts} a ON a.account_id = i.account_id WHERE i.amount_cents IS NOT NULL GROUP BY a.country HAVING count(*) >= :n", n=10)
# window
q("biggest_account_per_industry", "WITH n AS (SELECT a.account_id, a.name, a.industry, count(u.user_id) AS n FROM {accounts} a LEFT JOIN {users} u ON u.account_id = a.account_id GROUP BY a.account_id, a.name, a.industry), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, account_id) AS rn FROM n) SELECT industry, name, n FROM r WHERE rn = 1")
q("running_payments", "SELECT month, total, sum(total) OVER (ORDER BY month) AS running FROM (SELECT substring(paid_at, 1, 7) AS month, sum(amount_cents) AS total FROM {payments} WHERE status = 'succeeded' GROUP BY substring(paid_at, 1, 7)) m ORDER BY month")
q("latest_invoice_per_account", "SELECT account_id, invoice_id, issued_date FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY issued_date DESC, invoice_id DESC) AS rn FROM {invoices} WHERE status <> 'void') r WHERE rn = 1")
q("top_ticket_accounts_rank", "SELECT account_id, n, rk FROM (SELECT account_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM {tickets} GROUP BY account_id) r WHERE rk <= :k", k=5)
q("first_ticket_per_account", "SELECT account_id, ticket_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY opened_at, ticket_id) AS rn FROM {tickets} WHERE priority = 'high') r WHERE rn = 1")
q("payment_increase_over_previous", "SELECT payment_id, amount_cents - prev AS increase FROM (SELECT p.payment_id, p.amount_cents, lag(p.amount_cents) OVER (PARTITION BY i.account_id ORDER BY p.paid_at, p.payment_id, p.amount_cents) AS prev FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id) r WHERE prev IS NOT NULL AND amount_cents > prev")
q("ntile_accounts_by_users", "SELECT country, account_id, n FROM (SELECT a.country, a.account_id, count(u.user_id) AS n, ntile(4) OVER (PARTITION BY a.country ORDER BY count(u.user_id) DESC, a.account_id) AS tile FROM {accounts} a LEFT JOIN {users} u ON u.account_id = a.account_id GROUP BY a.country, a.account_id) r WHERE tile = 1")
q("running_usage_for_user", "SELECT usage_id, used_on, sum(event_count) OVER (ORDER BY used_on, usage_id) AS running FROM {usage} WHERE user_id = :u ORDER BY used_on, usage_id", u=7)
q("rank_accounts_in_country", "SELECT country, account_id, n, dense_rank() OVER (PARTITION BY country ORDER BY n DESC) AS rk FROM (SELECT a.country, a.account_id, count(u.user_id) AS n FROM {accounts} a LEFT JOIN {users} u ON u.account_id = a.account_id AND u.deleted_at IS NULL GROUP BY a.country, a.account_id) r")
# dates
q("invoices_in_month", "SELECT count(*) AS n FROM {invoices} WHERE substring(issued_date, 1, 7) = :m", m="1997-03")
q("avg_resolution_days", "SELECT priority, round(avg((MICROS(closed_at) - MICROS(opened_at)) / 8.64e10), 2) AS days FROM {tickets} WHERE closed_at IS NOT NULL GROUP BY priority")
q("late_payments", "SELECT p.payment_id FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id WHERE p.paid_at > i.due_date AND p.status = 'succeeded'")
q("accounts_in_quarter", "SELECT name FROM {accounts} WHERE created_at BETWEEN :lo AND :hi", lo="2022-04-01", hi="2022-06-31")
q("subs_active_on", "SELECT count(*) AS n FROM {subscriptions} WHERE start_date <= :d AND (end_date IS NULL OR end_date >= :d)", d="1998-01-01")
q("avg_days_to_pay", "SELECT p.method, round(avg((MICROS(CAST(p.paid_at AS TIMESTAMP)) - MICROS(CAST(i.issued_date AS TIMESTAMP))) / 8.64e10), 2) AS days FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id GROUP BY p.method")
q("slow_tickets", "SELECT ticket_id FROM {tickets} WHERE (MICROS(closed_at) - MICROS(opened_at)) / 8.64e10 > :n", n=3)
q("slow_first_invoice", "SELECT a.account_id, CAST(floor((MICROS(CAST(a.created_at AS TIMESTAMP)) - MICROS(CAST(min(i.issued_date) AS TIMESTAMP))) / 8.64e10) AS BIGINT) AS days FROM {accounts} a JOIN {invoices} i ON i.account_id = a.account_id GROUP BY a.account_id, a.created_at HAVING min(i.issued_date) > :d", d="1996-01-01")
q("payments_in_window", "SELECT count(*) AS n, sum(amount_cents) AS total FROM {payments} WHERE paid_at >= :lo AND paid_at < :hi", lo="1990-01-01", hi="1990-02-01")
# nulls
q("closed_no_csat", "SELECT count(*) AS n FROM {tickets} WHERE status = 'closed' AND csat_score IS NULL")
q("invoices_missing_amount", "SELECT invoice_id FROM {invoices} WHERE amount_cents IS NULL AND status = :s", s="paid")
q("never_logged_in", "SELECT u.email FROM {users} u JOIN {accounts} a ON a.account_id = u.account_id WHERE u.last_login_at IS NULL AND a.status = 'active'")
q("avg_amount_missing_as_zero", "SELECT round(avg(coalesce(amount_cents, 0)), 2) AS mean FROM {invoices} WHERE issued_date BETWEEN :lo AND :hi", lo="1996-01-01", hi="1996-12-31")
q("unassigned_by_country", "SELECT country, count(*) AS n FROM {accounts} WHERE sales_rep IS NULL GROUP BY country")
q("one_off_invoices", "SELECT count(*) AS n FROM {invoices} WHERE subscription_id IS NULL")
q("tickets_without_user", "SELECT sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS without_user, count(*) AS n FROM {tickets} WHERE opened_at >= TIMESTAMP '2024-01-05 00:00:00' AND opened_at < TIMESTAMP '2024-01-20 00:00:00'")
q("effective_revenue", "SELECT p.tier, round(sum(s.seats * p.monthly_price_cents / 100.0 * (1 - coalesce(s.discount_pct, 0))), 2) AS revenue FROM {subscriptions} s JOIN {plans} p ON p.plan_id = s.plan_id JOIN {accounts} a ON a.account_id = s.account_id WHERE s.status = 'active' AND a.deleted_at IS NULL GROUP BY p.tier")
q("accounts_missing_amounts", "SELECT account_id, count(*) AS n FROM {invoices} WHERE amount_cents IS NULL GROUP BY account_id HAVING count(*) >= :n", n=2)
q("accounts_rated_tickets", "SELECT a.account_id, a.name, round(avg(t.csat_score), 2) AS csat FROM {tickets} t JOIN {accounts} a ON a.account_id = t.account_id GROUP BY a.account_id, a.name HAVING count(t.csat_score) >= :n", n=2)
q("invoices_low_or_no_discount", "SELECT i.invoice_id FROM {invoices} i JOIN {subscriptions} s ON s.subscription_id = i.subscription_id WHERE s.discount_pct IS NULL OR s.discount_pct < :x", x=0.03)
# subqueries
q("accounts_above_avg_paid", "WITH t AS (SELECT i.account_id, sum(p.amount_cents) AS total FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id WHERE p.status = 'succeeded' GROUP BY i.account_id) SELECT account_id, total FROM t WHERE total > (SELECT avg(total) FROM t)")
q("users_in_tier_accounts", "SELECT email FROM {users} WHERE account_id IN (SELECT s.account_id FROM {subscriptions} s JOIN {plans} p ON p.plan_id = s.plan_id WHERE p.tier = :t)", t="Brand#2")
q("accounts_more_tickets_than_avg", "WITH t AS (SELECT account_id, count(*) AS n FROM {tickets} GROUP BY account_id) SELECT account_id, n FROM t WHERE n > (SELECT avg(n) FROM t)")
q("invoices_above_currency_avg", "SELECT i.invoice_id FROM {invoices} i WHERE i.amount_cents > (SELECT avg(j.amount_cents) FROM {invoices} j WHERE j.currency = i.currency) AND substring(i.issued_date, 1, 4) = :y", y="1998")
q("accounts_above_industry_avg_users", "WITH n AS (SELECT a.account_id, a.industry, a.status, count(u.user_id) AS n FROM {accounts} a LEFT JOIN {users} u ON u.account_id = a.account_id GROUP BY a.account_id, a.industry, a.status) SELECT x.account_id, x.n FROM n x WHERE x.status = 'active' AND x.n > (SELECT avg(y.n) FROM n y WHERE y.industry = x.industry)")
q("invoices_above_account_avg", "SELECT i.invoice_id FROM {invoices} i WHERE i.amount_cents > (SELECT avg(j.amount_cents) FROM {invoices} j WHERE j.account_id = i.account_id AND j.status <> 'void') AND i.status = 'open'")
q("users_in_ticket_heavy_accounts", "SELECT email FROM {users} WHERE account_id IN (SELECT account_id FROM {tickets} GROUP BY account_id HAVING count(*) > :n)", n=10)
q("busy_months", "WITH m AS (SELECT substring(issued_date, 1, 7) AS month, count(*) AS n FROM {invoices} GROUP BY substring(issued_date, 1, 7)) SELECT month, n FROM m WHERE n > (SELECT avg(n) FROM m) + :x", x=2)
q("accounts_latest_sub_plan", "SELECT a.account_id, s.plan_id, s.start_date FROM {accounts} a JOIN {subscriptions} s ON s.account_id = a.account_id WHERE s.start_date = (SELECT max(z.start_date) FROM {subscriptions} z WHERE z.account_id = a.account_id)")
# anti joins
q("accounts_no_tickets", "SELECT a.name FROM {accounts} a WHERE NOT EXISTS (SELECT 1 FROM {tickets} t WHERE t.account_id = a.account_id)")
q("accounts_no_tickets_outer", "SELECT a.name FROM {accounts} a LEFT JOIN {tickets} t ON t.account_id = a.account_id WHERE t.ticket_id IS NULL")
q("users_no_usage", "SELECT u.email FROM {users} u WHERE NOT EXISTS (SELECT 1 FROM {usage} f WHERE f.user_id = u.user_id AND f.feature = 'signup' AND f.used_on > '2024-01-27')")
q("invoices_no_success_payment", "SELECT i.invoice_id FROM {invoices} i WHERE NOT EXISTS (SELECT 1 FROM {payments} p WHERE p.invoice_id = i.invoice_id AND p.status = 'succeeded')")
q("accounts_no_active_sub", "SELECT a.name FROM {accounts} a WHERE NOT EXISTS (SELECT 1 FROM {subscriptions} s WHERE s.account_id = a.account_id AND s.status = 'active')")
q("accounts_no_payment_in_range", "SELECT a.name FROM {accounts} a WHERE NOT EXISTS (SELECT 1 FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id WHERE i.account_id = a.account_id AND p.paid_at BETWEEN :lo AND :hi)", lo="1996-01-01", hi="1997-12-31")
q("users_never_ticketed", "SELECT u.email FROM {users} u JOIN {accounts} a ON a.account_id = u.account_id WHERE u.deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM {tickets} t WHERE t.user_id = u.user_id AND t.priority = 'high' AND t.csat_score = 3 AND t.category = 'error' AND t.opened_at > TIMESTAMP '2024-01-20 00:00:00')")
q("uses_one_not_other", "SELECT DISTINCT a.name FROM {accounts} a JOIN {users} u ON u.account_id = a.account_id JOIN {usage} f ON f.user_id = u.user_id WHERE f.feature = :x AND NOT EXISTS (SELECT 1 FROM {users} v JOIN {usage} g ON g.user_id = v.user_id WHERE v.account_id = a.account_id AND g.feature = :y AND g.used_on < '2024-01-03')", x="view", y="signup")
q("invoices_never_paid_month", "SELECT i.invoice_id FROM {invoices} i LEFT JOIN {payments} p ON p.invoice_id = i.invoice_id WHERE p.payment_id IS NULL AND substring(i.issued_date, 1, 4) = :m", m="1997")
# soft deletes
q("live_users_per_account", "SELECT a.account_id, count(*) AS n FROM {users} u JOIN {accounts} a ON a.account_id = u.account_id WHERE u.deleted_at IS NULL AND a.deleted_at IS NULL GROUP BY a.account_id")
q("deleted_accounts_status", "SELECT status, count(*) AS n FROM {accounts} WHERE deleted_at IS NOT NULL AND deleted_at > :d GROUP BY status", d="2024-01-01")
q("live_users_by_role", "SELECT role, count(*) AS n FROM {users} WHERE deleted_at IS NULL AND last_login_at > :d GROUP BY role", d="2024-01-10")
q("accounts_with_deleted_users", "SELECT a.account_id, count(*) AS n FROM {accounts} a JOIN {users} u ON u.account_id = a.account_id WHERE a.deleted_at IS NULL AND u.deleted_at IS NOT NULL GROUP BY a.account_id HAVING count(*) >= 1")
q("last_live_login", "SELECT a.account_id, max(u.last_login_at) AS last_login FROM {accounts} a JOIN {users} u ON u.account_id = a.account_id WHERE u.deleted_at IS NULL GROUP BY a.account_id HAVING max(u.last_login_at) > :d", d="2024-01-12")
# conditional
q("invoice_size_buckets", "SELECT CASE WHEN amount_cents IS NULL THEN 'unknown' WHEN amount_cents < 5000000 THEN 'small' WHEN amount_cents < 20000000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM {invoices} GROUP BY bucket")
q("success_vs_failed", "SELECT i.account_id, sum(CASE WHEN p.status = 'succeeded' THEN p.amount_cents ELSE 0 END) AS ok, sum(CASE WHEN p.status = 'failed' THEN p.amount_cents ELSE 0 END) AS failed FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id GROUP BY i.account_id HAVING sum(CASE WHEN p.status = 'failed' THEN p.amount_cents ELSE 0 END) > :x", x=1_000_000)
q("tickets_open_closed_split", "SELECT category, count_if(status = 'open') AS open, count_if(status = 'closed') AS closed FROM {tickets} GROUP BY category")
q("seat_size_labels", "SELECT p.tier, CASE WHEN s.seats < 10 THEN 'small' WHEN s.seats < 30 THEN 'mid' ELSE 'big' END AS size, count(*) AS n FROM {subscriptions} s JOIN {plans} p ON p.plan_id = s.plan_id GROUP BY p.tier, size")
q("payment_status_pivot", "SELECT i.currency, count_if(p.status = 'succeeded') AS ok, count_if(p.status = 'failed') AS failed, count_if(p.method = 'R') AS returned FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id GROUP BY i.currency")
# sets
q("urgent_or_overdue", "SELECT account_id FROM {tickets} WHERE priority = 'high' UNION SELECT account_id FROM {invoices} WHERE status = 'open'")
q("high_and_void", "SELECT account_id FROM {tickets} WHERE priority = 'high' INTERSECT SELECT account_id FROM {invoices} WHERE status = 'void'")
q("ticket_union_invoice", "SELECT account_id FROM {tickets} WHERE category = 'error' AND csat_score < 3 UNION SELECT account_id FROM {invoices} WHERE amount_cents > :x", x=40_000_000)
q("plan_except_void", "SELECT account_id FROM {subscriptions} WHERE seats > 40 EXCEPT SELECT account_id FROM {invoices} WHERE status = 'void'")
q("users_both_features", "SELECT user_id FROM {usage} WHERE feature = 'purchase' INTERSECT SELECT f.user_id FROM {usage} f JOIN {users} u ON u.user_id = f.user_id WHERE f.feature = 'signup' AND u.deleted_at IS NULL")
# top n
q("top_accounts_paid", "SELECT name, total FROM (SELECT a.account_id, a.name, sum(p.amount_cents) AS total FROM {payments} p JOIN {invoices} i ON i.invoice_id = p.invoice_id JOIN {accounts} a ON a.account_id = i.account_id WHERE p.status = 'succeeded' GROUP BY a.account_id, a.name ORDER BY total DESC, a.account_id LIMIT 10) r")
q("latest_tickets", "SELECT ticket_id FROM {tickets} ORDER BY opened_at DESC, ticket_id DESC LIMIT 10")
q("top_users_usage", "SELECT user_id, sum(event_count) AS total FROM {usage} WHERE feature = :f GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10", f="purchase")
q("top_accounts_by_users", "SELECT a.name, count(*) AS n FROM {users} u JOIN {accounts} a ON a.account_id = u.account_id GROUP BY a.account_id, a.name ORDER BY n DESC, a.account_id LIMIT 10")
q("largest_invoices", "SELECT invoice_id, amount_cents FROM {invoices} WHERE amount_cents IS NOT NULL AND status = :s ORDER BY amount_cents DESC, invoice_id DESC LIMIT 10", s="paid")


def expand(sql: str, dialect: str) -> str:
    """Views as subqueries, and the dialect's spelling of microseconds. Base tables keep their braces."""
    while True:
        new = re.sub(r"\{(\w+)\}", lambda m: f"({VIEWS[m[1]]})" if m[1] in VIEWS else m[0], sql)
        if new == sql:
            break
        sql = new
    for name, spelled in SPELLED.items():
        sql = re.sub(rf"\b{name}\(({ARGUMENT}*)\)", spelled[dialect], sql)
    return sql


def literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, params: dict | None = None) -> DataFrame:
    sql = expand(sql, "spark")
    names = {t for t in BASE if f"{{{t}}}" in sql}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    df = spark.sql(sql, args=params or {}, **frames)
    decimals = {f.name: df[f.name].cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)}
    return df.withColumns(decimals) if decimals else df


def oracle(sql: str, params: dict | None = None) -> str:
    sql = re.sub(r"\{(\w+)\}", r"\1", expand(sql, "duckdb"))
    return re.sub(r":(\w+)\b", lambda m: literal(params[m[1]]) if params and m[1] in params else m[0], sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, sql=sql, params=params: run_sql(spark, sf_dir, sql, params) for name, (sql, params) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql, params) for name, (sql, params) in Q.items()}
