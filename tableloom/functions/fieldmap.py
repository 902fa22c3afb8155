"""From schema element names and types to generators and field types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part of a type name -> generator, tried in this order.
TYPE_GENERATORS = (
    ("decimal", "pydecimal"),
    ("int", "random_int"),
    ("date", "date_between"),
    ("boolean", "boolean"),
    ("time", "date_time"),
)

# Whole words in a field name (any case) -> generator, tried in this order.
NAME_GENERATORS = (
    (
        "amount|value|price|total|sum|limit|fee|tax|charge|rate|interest|payment_amount|sttlm_amt|instd_amt|"
        "reqd_advd_amt|ccy_amt",
        "pydecimal",
    ),
    ("currency|ccy", "currency_code"),
    ("bic|swift", "swift"),
    ("iban", "iban"),
    ("bban", "bban"),
    ("email|electronic_mail", "email"),
    ("phone|telephone|contact|mobile|fax", "phone_number"),
    ("country|ctry|nation|cntry", "country_code"),
    ("city|town|municipality", "city"),
    ("postal_code|zip|post_code|pstl_cd", "zipcode"),
    ("address|street|adr|line|pstl_adr", "street_address"),
    ("name|nm|full_name|surname|last_name|first_name|gvn_nm|faml_nm|middl_nm", "name"),
    ("date|dt|timestamp|datetime|cre_dt|due_date|reqd_exctn_dt|intnd_to_dt", "date_between"),
    ("uri|url|link|website|web", "url"),
    ("description|desc|purpose|purp|note|rmk|instr|addtl_inf", "text"),
    ("id|identifier|ref|reference|acct_id|tx_id|msg_id|msg_rcpt|end_to_end_id|uetr|clr_sys_ref", "bothify"),
    ("account|acct|acct_id", "bban"),
    ("bank|financial_institution|instg_agt|instd_agt|agt", "company"),
    ("status|stat|sts", "random_element"),
    ("type|tp|kind|categ|ctgy", "random_element"),
    ("code|cd", "bothify"),
    ("percent|pctg|pct", "pydecimal"),
    ("quantity|qty|count|nb|number|nmbr|total_qty", "random_int"),
    ("boolean|flag|indicator|ind|active|enabled|yes_no|authntcn_ind", "boolean"),
    ("credit|debit|cdt|dbt|charge", "random_element"),
    ("exchange|xchg_rate|rate|fx_rate", "pydecimal"),
    ("sequence|seq|order|ordr", "random_int"),
    ("version|vrsn", "random_int"),
)

# Part of a type name -> field type, by rule set, tried in this order.
FIELD_TYPES = {
    "strict": (("decimal", "float"), ("int", "integer"), ("boolean", "boolean"), ("time", "datetime"), ("date", "date")),
    "broad": (
        ("decimal|amount|price|rate", "float"),
        ("numeric|integer|year|index", "integer"),
        ("date|time|timestamp", "date"),
        ("boolean|indicator", "boolean"),
    ),
}
OTHER_GENERATOR = "text"
OTHER_TYPE = "string"


def local_name(name: Column) -> Column:
    """A name without its ``{namespace}`` or ``prefix:``."""
    return F.substring_index(F.regexp_replace(name, r"\{[^}]+\}", ""), ":", -1)


def generator_for(name: Column, xsd_type: Column, has_choices: Column) -> Column:
    """Generator of a schema field: choices first, then its type, then words in its name."""
    kind = F.lower(F.coalesce(F.substring_index(xsd_type, "}", -1), F.lit("")))
    rule = F.when(has_choices, F.lit("random_element"))
    for part, made in TYPE_GENERATORS:
        rule = rule.when(kind.contains(part), made)
    every = "|".join(words for words, _ in NAME_GENERATORS)
    rule = rule.when(~name.rlike(rf"(?iU)\b({every})\b"), OTHER_GENERATOR)  # most names match nothing: one test
    for words, made in NAME_GENERATORS:
        rule = rule.when(name.rlike(rf"(?iU)\b({words})\b"), made)
    return rule.otherwise(OTHER_GENERATOR)


def field_type_for(xsd_type: Column, rules: str = "strict") -> Column:
    """Field type of a schema type; ``strict`` knows datetimes, ``broad`` also reads amounts and years."""
    kind = F.lower(F.coalesce(F.substring_index(xsd_type, "}", -1), F.lit("")))
    chain = None
    for parts, made in FIELD_TYPES[rules]:
        hit = kind.rlike(parts)
        chain = F.when(hit, made) if chain is None else chain.when(hit, made)
    return chain.otherwise(OTHER_TYPE)
