"""Queries for the column functions and for history: F and H operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import confidence as conf
from claimgraph.functions import temporal as time
from claimgraph.functions import text
from claimgraph.operators import claims as reads
from claimgraph.operators import history
from claimgraph.plans.corpus import Corpus
from claimgraph.plans.oracle import BAND, UNDATED, certainly, oracle, possibly
from claimgraph.plans.registry import query
from claimgraph.schema import BOUNDS

Y98 = ("1998-01-01", "1998-12-31")
YEAR_98 = ("1998", "1998")
MICROS = "CAST(epoch_us(occurred_at) AS BIGINT)"


def micros(name: str):
    """Microseconds since 1970 of a zone-less timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(name))


@query("f01_possibly_active", oracle(f"SELECT claim_id, {possibly(*Y98)} AS possible FROM ties"))
def _(c: Corpus) -> DataFrame:
    return c.ties.select("claim_id", time.possibly_active(*time.window_bounds(*YEAR_98)).alias("possible"))


@query("f02_certainly_active", oracle(f"SELECT claim_id, {certainly(*Y98)} AS certain FROM ties"))
def _(c: Corpus) -> DataFrame:
    return c.ties.select("claim_id", time.certainly_active(*time.window_bounds(*YEAR_98)).alias("certain"))


@query("f03_is_undated", oracle(f"SELECT claim_id, {UNDATED} AS undated FROM ties"))
def _(c: Corpus) -> DataFrame:
    return c.ties.select("claim_id", time.is_undated().alias("undated"))


@query("f04_confidence_band", oracle(f"SELECT claim_id, {BAND} AS band FROM ties"))
def _(c: Corpus) -> DataFrame:
    return c.ties.select("claim_id", conf.confidence_band(F.col("confidence_point")).alias("band"))


@query(
    "f05_effective_confidence",
    oracle("""
SELECT claim_id, CASE WHEN manual IS NOT NULL THEN manual WHEN calib IS NOT NULL THEN calib ELSE source_point END AS point,
 CASE WHEN manual IS NOT NULL THEN 'manual' WHEN calib IS NOT NULL THEN 'calibration'
      WHEN source_point IS NOT NULL THEN 'source' ELSE 'unscored' END AS origin,
 CASE WHEN manual IS NULL AND calib IS NOT NULL THEN 'cal-1' END AS calibration_run_id
FROM (SELECT claim_id, confidence_point AS source_point, CASE WHEN quantity >= 40 THEN quantity/100 END AS manual,
      CASE WHEN second_support THEN confidence_point END AS calib FROM ties)"""),
)
def _(c: Corpus) -> DataFrame:
    manual = F.when(F.col("quantity") >= 40, F.col("quantity") / 100)
    calibrated = F.when(F.col("second_support"), F.col("confidence_point"))
    resolved = conf.effective_confidence(manual, calibrated, F.lit("cal-1"), F.col("confidence_point"))
    return c.ties.select("claim_id", resolved.alias("_e")).select("claim_id", "_e.*")


@query(
    "f06_wire_origin",
    oracle("""SELECT claim_id, CASE WHEN confidence_point IS NULL THEN NULL
 WHEN origin='manual' THEN 'manual' ELSE 'source_native' END AS wire_origin FROM claims"""),
)
def _(c: Corpus) -> DataFrame:
    return c.claims.select(
        "claim_id", conf.wire_origin(F.col("origin"), F.col("confidence_point")).alias("wire_origin")
    )


@query(
    "f07_passes_confidence",
    oracle("""SELECT claim_id, coalesce(confidence_point>=0.6,false) AS strict,
 confidence_point IS NULL OR confidence_point>=0.6 AS with_unscored FROM claims"""),
)
def _(c: Corpus) -> DataFrame:
    point = F.col("confidence_point")
    return c.claims.select(
        "claim_id",
        conf.passes_confidence(point, 0.6, False).alias("strict"),
        conf.passes_confidence(point, 0.6, True).alias("with_unscored"),
    )


@query(
    "f08_expand_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN year(o_orderdate)||'-01-01'
 ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS window_start,
 CASE WHEN o_orderstatus='F' THEN year(o_orderdate)||'-12-31'
 ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS window_end FROM orders""",
)
def _(c: Corpus) -> DataFrame:
    given = F.when(
        F.col("o_orderstatus") == "F", F.year("o_orderdate").cast("string")
    ).otherwise(F.to_date("o_orderdate").cast("string"))
    return c.table("orders").select(
        "o_orderkey",
        time.expand_date(given, False).alias("window_start"),
        time.expand_date(given, True).alias("window_end"),
    )


FUZZY = """CASE WHEN {e} IS NULL AND {l} IS NULL THEN 'date unknown'
 WHEN year({e})=year({l}) THEN {c}||CAST(year({e}) AS VARCHAR)
 WHEN {e} IS NOT NULL AND {l} IS NOT NULL THEN year({e})||'–'||year({l})
 WHEN {e} IS NOT NULL THEN 'after '||{c}||year({e}) ELSE 'before '||{c}||year({l}) END"""
CIRCA = "(CASE WHEN approximate THEN 'c. ' ELSE '' END)"


def fuzzy(e: str, late: str, circa: str = CIRCA) -> str:
    return FUZZY.format(e=e, l=late, c=circa)


VALID_TIME = f"""CASE WHEN {UNDATED} THEN 'date unknown'
 WHEN end_earliest IS NULL AND end_latest IS NULL THEN {fuzzy('start_earliest', 'start_latest')}
 WHEN start_earliest IS NULL AND start_latest IS NULL THEN {fuzzy('end_earliest', 'end_latest')}
 ELSE ({fuzzy('start_earliest', 'start_latest')})||'–'||({fuzzy('end_earliest', 'end_latest')}) END"""


@query(
    "f10_format_fuzzy",
    oracle(f"""SELECT claim_id, {fuzzy('start_earliest', 'start_latest')} AS start_text,
 {fuzzy('end_earliest', 'end_latest')} AS end_text FROM ties"""),
)
def _(c: Corpus) -> DataFrame:
    se, sl, ee, el = (F.col(b) for b in BOUNDS)
    circa = F.col("approximate")
    return c.ties.select(
        "claim_id",
        time.format_fuzzy(se, sl, circa).alias("start_text"),
        time.format_fuzzy(ee, el, circa).alias("end_text"),
    )


@query("f11_format_valid_time", oracle(f"SELECT claim_id, {VALID_TIME} AS valid_time FROM ties"))
def _(c: Corpus) -> DataFrame:
    return c.ties.select(
        "claim_id", time.format_valid_time(approximate=F.col("approximate")).alias("valid_time")
    )


@query(
    "f12_format_life_dates",
    oracle("""SELECT entity_id, CASE WHEN born_earliest IS NULL AND died_earliest IS NULL THEN 'dates unknown'
 WHEN died_earliest IS NULL THEN 'b. '||year(born_earliest) WHEN born_earliest IS NULL THEN 'd. '||year(died_earliest)
 ELSE year(born_earliest)||'–'||year(died_earliest) END AS life FROM summary"""),
)
def _(c: Corpus) -> DataFrame:
    life = time.format_life_dates("born_earliest", "born_latest", "died_earliest", "died_latest")
    return c.summary.select("entity_id", life.alias("life"))


@query(
    "f13_year_of",
    oracle("SELECT claim_id, CAST(year(start_earliest) AS INTEGER) AS y0, CAST(year(end_latest) AS INTEGER) AS y1 FROM ties"),
)
def _(c: Corpus) -> DataFrame:
    return c.ties.select(
        "claim_id",
        time.year_of(F.col("start_earliest")).alias("y0"),
        time.year_of(F.col("end_latest")).alias("y1"),
    )


CONFIDENCE_TEXT = f"""CASE WHEN confidence_point IS NULL THEN 'unscored · origin unrecorded' ELSE
 printf('%.2f', confidence_point)||' · '||replace({BAND},'_',' ')||' · '||
 CASE WHEN origin='manual' THEN 'manual override' ELSE 'source-native (uncalibrated)' END END"""


@query("f14_confidence_text", oracle(f"SELECT claim_id, {CONFIDENCE_TEXT} AS chip FROM claims"))
def _(c: Corpus) -> DataFrame:
    point = F.col("confidence_point")
    chip = conf.confidence_text(
        point, conf.wire_origin(F.col("origin"), point), F.lit(False), F.lit(None).cast("string")
    )
    return c.claims.select("claim_id", chip.alias("chip"))


@query("f15_literal_value", oracle("SELECT claim_id, value FROM attributes"))
def _(c: Corpus) -> DataFrame:
    return c.attributes.select("claim_id", text.literal_value(F.col("object_literal")).alias("value"))


@query(
    "f16_dates_or_null",
    oracle("""SELECT entity_id, born_earliest IS NULL AND born_latest IS NULL AND died_earliest IS NULL
 AND died_latest IS NULL AS no_dates, died_latest AS died_latest FROM summary"""),
)
def _(c: Corpus) -> DataFrame:
    names = ("born_earliest", "born_latest", "died_earliest", "died_latest")
    return c.summary.select("entity_id", time.dates_or_null(names).alias("life")).select(
        "entity_id", F.col("life").isNull().alias("no_dates"), F.col("life.died_latest").alias("died_latest")
    )


CITATION = f"""
SELECT claim_id, citation FROM (
 SELECT c.claim_id, row_number() OVER (PARTITION BY c.claim_id ORDER BY r.source_record_id) AS rn,
 a.display_name||' records "'||c.predicate||'" between '||s.display_name||' and '||coalesce(o.display_name, c.value, '—')||
 CASE WHEN {UNDATED} THEN '' ELSE ' ('||({VALID_TIME})||')' END||'.'||chr(10)||
 'Attestation: '||a.display_name||' ('||c.method||').'||chr(10)||
 'Source: '||src.title||', version '||src.version||' — '||src.retrieval_uri||'.'||chr(10)||
 CASE WHEN license_confirmed THEN '' ELSE 'License: unconfirmed — internal use only.'||chr(10) END||
 'Confidence: '||({CONFIDENCE_TEXT})||' [uncalibrated].'||chr(10)||'Accessed: 2026-01-01.'||chr(10)||
 'Reproducing view: https://example.org/claims/'||c.claim_id AS citation
 FROM claims c JOIN agt a ON a.agent_id=c.asserted_by_agent_id
 LEFT JOIN summary s ON s.entity_id=c.subject_entity_id LEFT JOIN summary o ON o.entity_id=c.object_entity_id
 JOIN sup u ON u.claim_id=c.claim_id JOIN rec r USING (source_record_id) JOIN src ON src.source_id=r.source_id
) WHERE rn=1"""


@query("f09_citation_text", oracle(CITATION))
def _(c: Corpus) -> DataFrame:
    detail = reads.claim_detail(c.claims, c.agents, c.summary)
    rows = reads.evidence(detail, c.support, c.records, c.sources)
    view = F.concat(F.lit("https://example.org/claims/"), F.col("claim_id").cast("string"))
    return reads.citation_text(rows, view, F.lit("2026-01-01"))


# History -------------------------------------------------------------------
# Ties replay in closed form: their events come in a fixed order.
TIE_STATUS = "SELECT claim_id, status, NULL AS error FROM ties"


@query(
    "h01_fold_status",
    oracle(f"""{TIE_STATUS} UNION ALL SELECT claim_id, status,
 CASE WHEN any_illegal THEN 'dispute of a superseded claim' WHEN status IS NULL THEN 'no assert event' END
 FROM attribute_status"""),
)
def _(c: Corpus) -> DataFrame:
    return history.fold_status(c.events)


@query(
    "h01b_raw_log_fold",
    oracle(
        "SELECT claim_id, status, CASE WHEN any_illegal THEN 'dispute of a superseded claim'"
        " WHEN status IS NULL THEN 'no assert event' END AS error FROM attribute_status",
        {
            "attribute_events": "SELECT id, claim_id, occurred_at, event_type, actor_agent_id, point FROM user_events",
        },
    ),
)
def _(c: Corpus) -> DataFrame:
    """The user events alone: logs without an assert, and disputes after a supersede."""
    return history.fold_status(c.user_events)


@query(
    "h02_current_confidence",
    oracle("SELECT claim_id, confidence_point, origin, NULL::VARCHAR AS calibration_run_id FROM claims"),
)
def _(c: Corpus) -> DataFrame:
    return history.current_confidence(c.recorded_claims, c.events)


@query(
    "h03_claim_history",
    oracle(f"""SELECT e.id, e.claim_id, e.event_type, {MICROS} AS at, a.slug AS actor_slug, a.kind AS actor_kind,
 a.display_name AS actor_name FROM log e JOIN agt a ON a.agent_id=e.actor_agent_id
 WHERE e.claim_id IN (SELECT claim_id FROM user_events)"""),
)
def _(c: Corpus) -> DataFrame:
    rows = history.claim_history(c.events, c.agents, c.user_events.select("claim_id"))
    return rows.select(
        "id", "claim_id", "event_type", micros("occurred_at").alias("at"),
        "actor_slug", "actor_kind", "actor_name",
    )


@query(
    "h04_event_feed",
    oracle(f"""SELECT id, claim_id, event_type, {MICROS} AS at FROM log
 WHERE occurred_at >= TIMESTAMP '1995-01-01' AND (occurred_at < TIMESTAMP '2024-01-03'
   OR (occurred_at = TIMESTAMP '2024-01-03' AND id < 'u-1000'))
 ORDER BY occurred_at DESC, id DESC LIMIT 200"""),
)
def _(c: Corpus) -> DataFrame:
    from datetime import datetime

    page = history.event_feed(
        c.events, since=datetime(1995, 1, 1), cursor=(datetime(2024, 1, 3), "u-1000"), limit=200
    )
    return page.select("id", "claim_id", "event_type", micros("occurred_at").alias("at"))


@query("h05_asserted", oracle("SELECT claim_id, predicate FROM claims WHERE status='asserted'"))
def _(c: Corpus) -> DataFrame:
    return history.asserted(c.claims).select("claim_id", "predicate")
