"""Alert routing into outbox tables (chat and mail). Network sends are out
of scope: each outbox row is what one notification would carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.values import fmt_fixed
from tickspark.schemas import DEFAULT_COLOR, SEVERITY_COLOR, SEVERITY_RANK

# channel -> (default minimum severity, rank of an unknown minimum)
CHANNELS = {"chat": ("low", 0), "mail": ("high", 2)}


def severity_rank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    expr = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(c == name, F.lit(rank)).otherwise(expr)
    return expr


def _min_rank(channel: str, minimum: str | None) -> int:
    default, unknown = CHANNELS[channel]
    m = (minimum if minimum is not None else default).strip().lower()
    return SEVERITY_RANK.get(m, unknown)


def route(alerts: DataFrame, minimums: dict[str, str | None] | None = None) -> DataFrame:
    """One row per (alert, channel) whose severity rank reaches the channel's
    minimum. Unknown event severities rank 0."""
    minimums = minimums or {}
    entries = F.array(*[F.struct(F.lit(ch).alias("channel"), F.lit(_min_rank(ch, minimums.get(ch))).alias("min_rank"))
                        for ch in CHANNELS])
    fanned = alerts.withColumn("_ch", F.explode(entries))
    return (fanned.filter(severity_rank("severity") >= F.col("_ch.min_rank"))
            .withColumn("channel", F.col("_ch.channel")).drop("_ch"))


def _fields() -> list[tuple[str, Column, Column]]:
    """(title, present, value text) of the optional alert fields."""
    return [
        ("Trigger Price", F.col("trigger_price").isNotNull(), F.concat(F.lit("$"), fmt_fixed("trigger_price", 4))),
        ("Trigger Volume", F.col("trigger_volume").isNotNull(), F.format_number(F.col("trigger_volume").cast("long"), 0)),
        ("Z-Score", F.col("zscore").isNotNull(), fmt_fixed("zscore", 2)),
        ("Reference Value", F.col("reference_value").isNotNull(), fmt_fixed("reference_value", 4)),
        ("Window", F.col("window_sec").isNotNull(), F.concat(F.col("window_sec").cast("string"), F.lit("s"))),
    ]


def chat_outbox(alerts: DataFrame) -> DataFrame:
    """Chat attachment payload as JSON text: colour by severity (grey if
    unknown), fixed fields then the optional ones that are present."""
    color = F.lit(DEFAULT_COLOR)
    for sev, col in SEVERITY_COLOR.items():
        color = F.when(F.col("severity") == sev, F.lit(col)).otherwise(color)
    fixed = [F.struct(F.lit(t).alias("title"), v.alias("value"), F.lit(True).alias("short"))
             for t, v in [("Symbol", F.col("symbol")), ("Alert Type", F.col("alert_type")),
                          ("Severity", F.upper("severity"))]]
    optional = [F.when(p, F.struct(F.lit(t).alias("title"), v.alias("value"), F.lit(True).alias("short")))
                for t, p, v in _fields()]
    attachment = F.struct(
        color.alias("color"),
        F.concat(F.lit(":rotating_light: Market Alert — "), F.col("symbol")).alias("title"),
        F.col("message").alias("text"),
        F.array_compact(F.array(*fixed, *optional)).alias("fields"),
        F.concat(F.lit("event_id: "), F.col("event_id")).alias("footer"),
        F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 1_000_000).alias("ts"))
    return alerts.select("event_id", "symbol", "severity",
                         F.to_json(F.struct(F.array(attachment).alias("attachments"))).alias("payload"))


def mail_outbox(alerts: DataFrame) -> DataFrame:
    """Mail subject, plain-text fallback and HTML table body."""
    subject = F.concat(F.lit("["), F.upper("severity"), F.lit("] Market Alert — "), F.col("symbol"),
                       F.lit(" / "), F.col("alert_type"))
    row_html = lambda k, v: F.concat(
        F.lit("<tr><td style='padding:4px 12px;font-weight:bold'>"), F.lit(k),
        F.lit("</td><td style='padding:4px 12px'>"), v, F.lit("</td></tr>"))
    rows = [row_html("Symbol", F.col("symbol")), row_html("Alert Type", F.col("alert_type")),
            row_html("Severity", F.upper("severity")), row_html("Message", F.col("message"))]
    rows += [F.when(p, row_html(t, v)) for t, p, v in _fields()]
    rows.append(row_html("Event ID", F.col("event_id")))
    html = F.concat(F.lit("\n<html><body>\n<h2 style='color:#cc0000'>Market Alert — "), F.col("symbol"),
                    F.lit("</h2>\n<table border='0' cellpadding='0' cellspacing='0'>\n"),
                    F.concat_ws("", *rows), F.lit("\n</table>\n</body></html>\n"))
    return alerts.select("event_id", "symbol", "severity", subject.alias("subject"),
                         F.concat(F.lit("Market Alert: "), subject, F.lit("\n\n"), F.col("message")).alias("text"),
                         html.alias("html"))


def recipients(mail: DataFrame, to_raw: str) -> DataFrame:
    """Fan a mail out to every address of a comma-separated list; blank
    entries are dropped, the others kept untrimmed."""
    addrs = F.filter(F.split(F.lit(to_raw), ","), lambda a: F.trim(a) != "")
    return mail.select("event_id", "subject", F.explode(addrs).alias("recipient"))
