"""Raw CRM feeds shaped from the driver tables: a flat one (A) and a nested one (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import by_value, cases
from quotaloom.plans.registry import job
from quotaloom.sources.warehouse import shifted

DAY_MS = 86_400_000


def epoch_ms(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS


def _stage() -> Column:
    k = F.col("o_orderkey")
    return by_value(k % 6, {0: "Prospecting", 1: "Discovery", 2: "Proposal", 3: "Negotiation", 4: "Closed Won"}, "Closed Lost")


@job
def crm_a_user(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    side = by_value(k % 3, {0: "West ", 1: "East "}, "")
    return supplier.select(k.alias("Id"), F.concat(F.lit("Rep "), side, k.cast("string")).alias("Name"))


@job
def crm_a_account(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("Id"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Industry"),
        ((k * 7919) % 2000 * 100000.0).alias("AnnualRevenue"), ((k * 31) % 2500).cast("int").alias("NumberOfEmployees"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("c_name", "#", "")), F.lit(".example")).alias("Website"),
        F.floor(k / 15).alias("OwnerId"),
    )


@job
def crm_a_opportunity(orders: DataFrame) -> DataFrame:
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    return orders.select(
        k.alias("Id"), F.concat(F.lit("Deal "), k.cast("string")).alias("Name"), F.col("o_custkey").alias("AccountId"),
        F.floor(F.col("o_custkey") / 15).alias("OwnerId"), F.col("o_totalprice").alias("Amount"), _stage().alias("StageName"),
        F.date_add(on, (30 + k % 90).cast("int")).alias("CloseDate"), on.alias("CreatedDate"),
        F.date_add(on, (k % 30).cast("int")).alias("LastModifiedDate"),
        by_value(k % 4, {0: "Inbound", 1: "Outbound", 2: "Partner"}, "Event").alias("LeadSource"),
        (k % 6 >= 4).alias("IsClosed"), (k % 6 == 4).alias("IsWon"),
    )


@job
def crm_a_opportunity_changes(crm_a_opportunity: DataFrame) -> DataFrame:
    """The export again, later: every tenth deal has moved on."""
    moved = F.col("Id") % 10 == 5
    return crm_a_opportunity.withColumns(
        {
            "Amount": F.when(moved, F.col("Amount") + 1000).otherwise(F.col("Amount")), "StageName": F.when(moved, F.lit("Negotiation")).otherwise(F.col("StageName")),
            "LastModifiedDate": F.when(moved, F.date_add("LastModifiedDate", 3000)).otherwise(F.col("LastModifiedDate")),
        }
    )


@job
def stored_opportunities(crm_a_opportunity: DataFrame, *, as_of) -> DataFrame:
    """Staging table as the run of a year ago left it."""
    names = {"Id": "opportunity_id", "Name": "opportunity_name", "AccountId": "account_id", "Amount": "amount", "StageName": "stage_name", "LastModifiedDate": "last_modified_date"}
    return crm_a_opportunity.filter(F.col("LastModifiedDate") <= F.date_sub(F.lit(as_of), 365)).select(*(F.col(a).alias(b) for a, b in names.items()))


@job
def crm_a_contact(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    return customer.select(
        k.alias("Id"), text("First", 20).alias("FirstName"), text("Last", 50).alias("LastName"),
        F.concat(text("c", 400), F.lit("@mail.example")).alias("Email"), F.concat(F.lit("+1-555-"), F.lpad(k.cast("string"), 7, "0")).alias("Phone"),
        by_value(k % 3, {0: "CEO", 1: "CTO"}, "Buyer").alias("Title"), by_value(k % 2, {0: "IT"}, "Finance").alias("Department"),
        k.alias("AccountId"), F.floor(k / 15).alias("OwnerId"), F.lit("Inbound").alias("LeadSource"),
    )


@job
def crm_a_task(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.filter(F.col("event_type").isin("click", "view", "error")).select(
        k.alias("Id"), by_value("event_type", {"click": "Email", "view": "Call"}).alias("TaskSubtype"),
        F.concat(F.lit("Task "), k.cast("string")).alias("Subject"), F.col("props").alias("Description"),
        F.when(k % 5 != 0, F.to_date(shifted())).alias("ActivityDate"), F.to_date(shifted()).alias("CreatedDate"),
        F.when(F.col("event_type") == "view", F.floor(F.col("value") * 60).cast("int")).alias("CallDurationInSeconds"),
        F.col("user_id").alias("OwnerId"), F.col("user_id").alias("AccountId"), F.floor(k / 3).alias("WhatId"), (k % 5).alias("WhoId"),
        F.when(k % 4 == 0, F.lit("Open")).otherwise(F.lit("Completed")).alias("Status"), F.lit("Normal").alias("Priority"),
    )


@job
def crm_a_event(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.filter(F.col("event_type").isin("purchase", "signup")).select(
        k.alias("Id"), F.when(F.col("event_type") == "signup", F.lit("Product Demo")).otherwise(F.lit("Review")).alias("Subject"),
        F.col("props").alias("Description"), F.to_date(shifted()).alias("ActivityDate"), F.to_date(shifted()).alias("CreatedDate"),
        F.floor("value").cast("int").alias("DurationInMinutes"), F.col("user_id").alias("OwnerId"), F.col("user_id").alias("AccountId"),
        F.floor(k / 3).alias("WhatId"), (k % 5).alias("WhoId"),
    )


@job
def crm_b_owner(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(k.alias("ownerId"), F.lit("Rep").alias("firstName"), k.cast("string").alias("lastName"))


@job
def crm_b_company(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    made = epoch_ms(F.lit("1999-01-01").cast("date")) + (k % 1000) * DAY_MS
    return customer.select(
        k.alias("companyId"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
        ((k * 7919) % 2000 * 100000).cast("string").alias("annualrevenue"), ((k * 31) % 2500).cast("string").alias("numberofemployees"),
        F.floor(k / 15).alias("hubspot_owner_id"), F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit(".example")).alias("website"),
        made.alias("createdate"), (made + 3600000).alias("hs_lastmodifieddate"),
    )


@job
def crm_b_match_names(crm_b_company: DataFrame) -> DataFrame:
    """The second CRM's companies as matching sees them: every second has a website, every third a misspelt name,
    every seventh another name, every fifth a manual entry."""
    k = F.col("companyId")
    typo = F.concat(F.lit("custome"), F.substring(F.lower("name"), F.lit(9), F.length("name")))
    return crm_b_company.select(
        k.alias("id"), F.when(k % 3 == 0, typo).when(k % 7 == 0, F.concat(F.lit("other "), k.cast("string"))).otherwise(F.lower("name")).alias("name"),
        F.when(k % 2 == 0, F.col("website")).alias("domain"), F.when(k % 5 == 0, k).alias("manual_id"),
    )


@job
def crm_b_deal(orders: DataFrame) -> DataFrame:
    # Pipeline stage codes of feed B.
    codes = {0: "appointmentscheduled", 1: "qualifiedtobuy", 2: "presentationscheduled", 3: "decisionmakerboughtin", 4: "contractsent", 5: "closedwon", 6: "closedlost"}
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    return orders.select(
        k.alias("dealId"), F.concat(F.lit("Deal "), k.cast("string")).alias("dealname"),
        F.when(k % 20 != 0, F.array(F.col("o_custkey"), k)).otherwise(F.array().cast("array<bigint>")).alias("associatedCompanyIds"),
        F.floor(F.col("o_custkey") / 15).alias("hubspot_owner_id"), F.col("o_totalprice").cast("string").alias("amount"),
        by_value(k % 8, codes, "other").alias("dealstage"),
        epoch_ms(F.date_add(on, 60)).alias("closedate"), epoch_ms(on).alias("createdate"),
        (epoch_ms(on) + (k % 86400) * 1000).alias("hs_lastmodifieddate"), F.lit("default").alias("pipeline"),
    )


@job
def crm_b_engagement(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    ids = lambda x: F.when(k % 10 != 0, F.array(x)).otherwise(F.array().cast("array<bigint>"))
    kind = by_value("event_type", {"click": "EMAIL", "view": "CALL", "purchase": "MEETING", "signup": "NOTE"}, "TASK")
    return events.select(
        k.alias("engagementId"), kind.alias("type"), (epoch_ms(F.to_date(shifted())) + (k % 86400) * 1000).alias("timestamp"),
        F.col("user_id").alias("ownerId"),
        F.struct(
            F.concat(F.lit("Touch "), k.cast("string")).alias("subject"), F.col("props").alias("body"),
            F.when(F.col("event_type") == "view", F.floor(F.col("value") * 1000).cast("bigint") * 60).alias("durationMilliseconds"),
        ).alias("metadata"),
        F.struct(ids(F.col("user_id")).alias("companyIds"), ids(F.floor(k / 3)).alias("dealIds"), ids(k % 5).alias("contactIds")).alias("associations"),
    )


@job
def crm_b_contact(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    value = lambda x: F.struct(x.alias("value"))
    added = epoch_ms(F.lit("2000-01-01").cast("date")) + (k % 500) * DAY_MS
    return customer.select(
        k.alias("vid"),
        F.struct(
            value(F.concat(F.lit("c"), (k % 400).cast("string"), F.lit("@mail.example"))).alias("email"),
            value(F.concat(F.lit("First"), (k % 20).cast("string"))).alias("firstname"),
            value(F.concat(F.lit("Last"), (k % 50).cast("string"))).alias("lastname"),
            value(by_value(k % 3, {0: "CEO", 1: "CTO"}, "Buyer")).alias("jobtitle"),
            value(F.floor(k / 15)).alias("hubspot_owner_id"),
            value(cases([(k % 4 == 0, "customer")], "lead")).alias("lifecyclestage"),
            value(F.when(k % 5 != 0, added + 5000)).alias("lastmodifieddate"),
        ).alias("properties"),
        F.struct(k.alias("companyId")).alias("associated-company"),
        added.alias("addedAt"),
    )


@job
def crm_b_email_event(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.filter("event_type = 'click'").select(
        k.alias("id"), (k % 8).alias("emailCampaignId"), F.concat(F.lit("c"), (k % 400).cast("string"), F.lit("@mail.example")).alias("recipient"),
        by_value(k % 5, {0: "SENT", 1: "DELIVERED", 2: "OPEN", 3: "CLICK"}, "BOUNCE").alias("type"),
        (epoch_ms(F.to_date(shifted())) + (k % 86400) * 1000).alias("created"), F.lit(77).alias("portalId"),
    )
