"""Business documents written out from orders, customers and their lines: invoices, receipts, contracts and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.tables import spread, table

#: One text for each o_orderkey modulo their number; {key}, {company}, {money}, {date}, {due}, {year}, {clerk}.
TEMPLATES = [
    "{company}\nInvoice No: INV-{key}\nDate: {date}\nDue date: {due}\nItem lines: {lines}\nTotal: USD {money}\nVAT no: 1{key9}\n",
    "{company}\nReceipt voucher {key}\nPayment received on {date}\nAED {money} for electricity and water\n",
    "Service Agreement {key}\nName: {company}\nbetween the first party and the second party\nAnnual rent: {money} AED\nexpiry date: {due}\n",
    "Account statement {key}\n{company}\nIBAN: AE07 0331 2345 6789 0123 456\nClosing balance EUR {money} on {date}\n",
    "Certificate of completion\n{company}\nNo {key} of {date}\n",
    "City hospital\npatient {company}\nprescription {key} of {date}\nprice GBP {money}\n",
    "Federal Law No. {key} of {year}\non trade by {company}\nArticle 1 refers to Decree No. 7 of 1999\nName: {company}\n",
    "Passport of the bearer\nName: {company}\nissued {date}, expiry date: {due}\n",
    "Application form {key}\nname: {company}\nfiled {date}\n",
    "Memo {key}\nfrom {company}\nnothing else to say ????\n",
]
NAMES = ["invoice_{key}.pdf", "receipt-{key}.png", "contract_{key}.docx", "statement_{key}.xlsx", "certificate_{key}.pdf", "lab-{key}.pdf", "federal_law_{key}.pdf", "passport_{key}.jpg", "form_{key}.docx", "memo_{key}.txt"]


def _filled(template: str, values: dict):
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, text, template, mtime) of each order that has a customer."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    values = {
        "key": key, "key9": F.lpad(key, 9, "0"), "company": F.concat(F.lit("Firm "), F.col("c_name")), "money": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "due": F.date_format("o_orderdate", "dd/MM/yyyy"), "year": F.date_format("o_orderdate", "yyyy"), "lines": F.coalesce(F.col("n_lines"), F.lit(0)).cast("string"),
    }
    n = len(TEMPLATES)
    template = F.pmod("o_orderkey", F.lit(n)).cast("int")

    def pick(table: list[str]):
        out = F.lit(None).cast("string")
        for k in reversed(range(n)):  # of the texts only a row's own is made
            out = F.when(template == k, _filled(table[k], values)).otherwise(out)
        return out

    return rows.select(F.col("o_orderkey").alias("doc_id"), pick(NAMES).alias("name"), pick(TEMPLATES).alias("text"), template.alias("template"), F.unix_timestamp("o_orderdate").alias("mtime"))
