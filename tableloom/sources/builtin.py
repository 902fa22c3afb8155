"""Reference rows that ship with the library: business domains, messages and demo fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domain id and name.
DOMAINS = [("1", "Payments"), ("6", "Securities"), ("11", "Trade Finance"), ("16", "Cards"), ("21", "FX")]

# Message id, name and business area; all are submitted by the same organisation.
MESSAGES = [
    ("pacs.008.001.12", "FIToFICustomerCreditTransfer", "Payments"),
    ("pacs.009.001.12", "FinancialInstitutionCreditTransfer", "Payments"),
    ("pacs.004.001.12", "PaymentReturn", "Payments"),
    ("pain.001.001.12", "CustomerCreditTransferInitiation", "Payments"),
    ("pain.002.001.13", "CustomerPaymentStatusReport", "Payments"),
    ("camt.053.001.12", "BankToCustomerStatement", "Payments"),
    ("camt.054.001.12", "BankToCustomerDebitCreditNotification", "Payments"),
    ("camt.056.001.11", "FIToFIPaymentCancellationRequest", "Payments"),
    ("seev.031.001.14", "CorporateActionInstruction", "Securities"),
    ("seev.002.001.14", "CorporateActionMovementConfirmation", "Securities"),
    ("setr.002.001.09", "OrderConfirmation", "Securities"),
    ("fxtr.010.001.03", "TradeConfirmation", "FX"),
]
SUBMITTER = "SWIFT"

# Demo message fields as name, type, generator, least occurrence, documentation, enum values.
DEMO_FIELDS = [
    ("MessageId", "Max35Text", "bothify", 1, "Unique message identifier", None),
    ("CreationDateTime", "ISODateTime", "date_time", 1, "Date and time of message creation", None),
    ("NumberOfTransactions", "Max15NumericText", "random_int", 1, None, None),
    ("TotalAmount", "DecimalNumber", "pydecimal", 1, "Total transaction amount", None),
    ("Currency", "ActiveCurrencyCode", "currency_code", 1, None, ["EUR", "USD", "GBP", "CHF", "JPY"]),
    ("Status", "TransactionStatus", "random_element", 1, None, ["ACCC", "ACSP", "ACSC", "ACCP", "RJCT", "PDNG"]),
    ("DebtorName", "Max140Text", "name", 1, None, None),
    ("DebtorIBAN", "IBAN2007Identifier", "iban", 1, None, None),
    ("CreditorName", "Max140Text", "name", 1, None, None),
    ("CreditorIBAN", "IBAN2007Identifier", "iban", 1, None, None),
    ("BIC", "BICIdentifier", "swift", 1, None, None),
    ("ChargeBearer", "ChargeBearerType1Code", "random_element", 1, None, ["DEBT", "CRED", "SHAR", "SLEV"]),
    ("Purpose", "Max140Text", "random_element", 0, None, ["SALA", "SUPP", "TAXS", "INTC", "TRAD", "CONS", "GOVT"]),
    ("RemittanceInfo", "Max140Text", "text", 0, "Unstructured remittance information", None),
    ("Country", "CountryCode", "country_code", 1, None, ["DE", "FR", "GB", "IT", "ES", "NL", "BE", "AT", "CH"]),
]


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "id string, name string")


def messages(spark: SparkSession) -> DataFrame:
    rows = [(i, n, SUBMITTER, a, None) for i, n, a in MESSAGES]
    return spark.createDataFrame(
        rows, "message_id string, message_name string, submitting_org string, business_area string, xsd_url string"
    )


def demo_fields(spark: SparkSession) -> DataFrame:
    """The demo fields in the shape ``xsd_fields`` returns (used when a message has no schema)."""
    rows = [
        ("demo", "", at, name, kind, least, "1", doc, values, [], made)
        for at, (name, kind, made, least, doc, values) in enumerate(DEMO_FIELDS)
    ]
    return spark.createDataFrame(
        rows,
        "document string, namespace string, position int, name string, xsd_type string, min_occurs int, "
        "max_occurs string, documentation string, enumeration_values array<string>, "
        "nested array<struct<name:string,type:string,min:string,max:string>>, mapped_generator string",
    )
