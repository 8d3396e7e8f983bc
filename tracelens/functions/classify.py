"""Payment classification, initiation, app and bank attribution, direction and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelens.functions.identity import psp
from tracelens.functions.payload import Leg, at, kind_at, long_at, text_at
from tracelens.functions.values import filled
from tracelens.operators.skew import dim_join

# Initiation mode codes.
INITIATION_MODES = {
    "00": "DEFAULT", "01": "STATIC_QR", "02": "DYNAMIC_QR", "03": "INTENT", "04": "QR_GALLERY", "05": "SECURE_QR",
    "06": "NFC", "08": "AADHAAR", "09": "COLLECT", "10": "FOREIGN_INWARD", "11": "TOKENISED",
}
QR_MODES = ["01", "02", "04", "05"]

# Handle -> app, used only when no configuration names the handle.
KNOWN_HANDLES = {
    "yescred": "CRED", "axisb": "CRED", "ptybl": "Paytm", "okbizicici": "Google Pay", "okhdfcbank": "Google Pay",
    "axisbnk": "Axis Pay", "abfspay": "Aditya Birla Pay", "freecharge": "Freecharge", "jupiteraxis": "Jupiter",
    "fbl": "Federal Bank",
}

# Handle -> bank id.
HANDLE_BANKS = {
    "hdfcbank": "HDFC", "sbi": "SBIN", "icici": "ICIC", "axisbank": "UTIB", "kotak": "KKBK", "rbl": "RATN",
    "kvb": "KVBL", "indus": "INDB", "pnb": "PUNB", "boi": "BKID", "canara": "CNRB", "idfcbank": "IDFB",
    "yesbank": "YESB", "uboi": "UBIN", "barb": "BARB",
}

# Direction by record type (payload layout and leg layout).
TYPE_DIRECTION = {
    "RECEIVED_PAYMENT": "IN", "USER_TO_USER_RECEIVED_REQUEST": "IN", "RECEIVED_MANDATE_CREATE_REQUEST": "IN",
    "P2P_ENRICHMENT": "META", "SENT_PAYMENT": "OUT", "EXTERNAL_PAYMENT": "OUT", "PHONE_RECHARGE": "OUT",
    "BILL_PAYMENT": "OUT", "SERVICE_MANDATE_CREATE": "OUT", "SYMPHONY": "META",
}
LEG_TYPE_DIRECTION = {
    "RECEIVED_PAYMENT": "IN", "SENT_PAYMENT": "OUT", "EXPENSE_SETTLEMENT": "OUT", "PIEDPIPER_PAYMENT": "OUT",
    "P2P_ENRICHMENT": "INTERNAL",
}
SELF_EVIDENT_TYPES = ["RECEIVED_PAYMENT", "SENT_PAYMENT", "P2P_ENRICHMENT"]
PERSON_TYPES = ["VPA", "PHONE", "INTERNAL_USER", "EXTERNAL_USER"]
SERVICE_TYPES = ["PHONE_RECHARGE", "EXTERNAL_PAYMENT", "SYMPHONY"]


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def classify(v: Column) -> Column:
    """MERCHANT, PEER_TO_PEER, MANDATE, MERCHANT_REFUND or OTHER; the first rule that holds decides."""
    to, frm = Leg(v, "to"), Leg(v, "from", only_object=True)
    mode = at(v, "context.transferMode")
    mandate = F.coalesce(*[kind_at(v, p) for p in ("mandateAmount", "mandateId", "mandateRequestNote")]).isNotNull()
    mcc = F.when((to.kind("mcc") == "STRING") | (to.amount("mcc") != 0), to.text("mcc"))
    merchant = (
        F.coalesce(to.raw("type") == "MERCHANT", F.lit(False))
        | to.text("merchantId", "merchantType", "merchantIdentifierType", "subMerchantId").isNotNull()
        | to.is_true("firstPartyMerchant")
        | F.coalesce(mcc != "0000", F.lit(False))
        | text_at(v, "context.serviceContext.serviceType", "context.merchantOrderId").isNotNull()
    )
    person = F.coalesce(to.raw("type").isin(PERSON_TYPES), F.lit(False)) | F.coalesce(
        frm.raw("type").isin(PERSON_TYPES), F.lit(False)
    )
    return (
        F.when(mode == "PEER_TO_MERCHANT", "MERCHANT")
        .when(mode == "PEER_TO_PEER", "PEER_TO_PEER")
        .when(mandate, "MANDATE")
        .when(merchant, "MERCHANT")
        .when(frm.raw("type") == "MERCHANT", "MERCHANT_REFUND")
        .when(person, "PEER_TO_PEER")
        .otherwise("OTHER")
    )


def classify_by_leg(party_type: Column, first_party: Column, record_type: Column) -> Column:
    """The short form used when only the counterparty leg's own type is known."""
    return (
        F.when((party_type == "MERCHANT") | first_party, "MERCHANT")
        .when(record_type.isin("SENT_PAYMENT", "RECEIVED_PAYMENT"), "PEER_TO_PEER")
        .when(record_type == "EXPENSE_SETTLEMENT", "SPLIT_SETTLEMENT")
    )


def merchant_subtype(v: Column, own_handle: Column) -> Column:
    """MERCHANT_ON_APP or MERCHANT_THIRD_PARTY; ``own_handle`` says whether the handle is first-party."""
    to = Leg(v, "to")
    address = to.text("vpa", "fullVpa")
    kind = F.upper(F.coalesce(to.raw("merchantType"), F.lit("")))
    return (
        F.when(to.is_true("firstPartyMerchant"), "MERCHANT_ON_APP")
        .when(address.contains("@"), F.when(own_handle, "MERCHANT_ON_APP").otherwise("MERCHANT_THIRD_PARTY"))
        .when(kind.contains("INAPP") | kind.contains("AGGREGATOR"), "MERCHANT_ON_APP")
        .when(to.text("merchantId").isNotNull() | (to.raw("type") == "MERCHANT"), "MERCHANT_THIRD_PARTY")
    )


def initiation(v: Column) -> Column:
    """How a payment was started; codes outside the table are shown as UNKNOWN_<code>."""
    code = F.coalesce(at(v, "context.upiInitiationMode"), F.lit(""))
    raw = F.coalesce(at(v, "context.initiationMode"), F.lit(""))
    return F.struct(
        F.coalesce(mapped(code, INITIATION_MODES), F.when(code != "", F.concat(F.lit("UNKNOWN_"), code)), F.lit("")).alias("payment_initiation"),
        code.isin(QR_MODES).alias("is_qr_scan"),
        ((code == "03") | (raw == "INTENT")).alias("is_intent"),
        F.coalesce(at(v, "context.refUrl"), F.lit("")).alias("intent_caller_url"),
        F.coalesce(at(v, "context.transferMode"), F.lit("")).alias("transfer_mode"),
        code.alias("upi_initiation_mode"),
        raw.alias("raw_initiation_mode"),
    )


def stated_mode(v: Column, mode: str) -> Column:
    """True or false only where the payload names a mode; otherwise null."""
    return at(v, "context.initiationMode") == mode


def handle_dimension(config_handles: DataFrame, banks: DataFrame, own_handles: DataFrame) -> DataFrame:
    """One row per known handle: label and how it is known.

    ``config_handles(handle, app_title)``, ``banks(bank_id, bank_name)`` and ``own_handles(handle)``
    are master tables.  Sources are tried in order: configuration, bank master, fixed table.
    """
    spark = config_handles.sparkSession
    fixed = spark.createDataFrame(list(KNOWN_HANDLES.items()), "handle string, app_title string")
    bank_of = spark.createDataFrame(list(HANDLE_BANKS.items()), "handle string, bank_id string")
    tiers = (
        config_handles.select("handle", F.col("app_title").alias("label"), F.lit("authoritative (app configuration)").alias("source"), F.lit(1).alias("tier"))
        .unionByName(
            bank_of.join(banks, "bank_id").select(
                "handle", F.concat("bank_name", F.lit(" (bank-direct)")).alias("label"), F.lit("bank master").alias("source"), F.lit(2).alias("tier")
            )
        )
        .unionByName(
            fixed.select("handle", F.concat("app_title", F.lit(" (inference)")).alias("label"), F.lit("inference (well-known handle)").alias("source"), F.lit(3).alias("tier"))
        )
    )
    best = tiers.groupBy("handle").agg(F.min_by(F.struct("label", "source"), F.struct("tier", "label")).alias("b"))
    named = best.select("handle", "b.label", "b.source")
    own = own_handles.select(F.lower("handle").alias("handle")).distinct().withColumn("own", F.lit(True))
    return named.join(own, "handle", "full_outer").select("handle", "label", "source", F.coalesce("own", F.lit(False)).alias("own_handle"))


def attribute_app(df: DataFrame, address: str, handles: DataFrame, prefix: str) -> DataFrame:
    """Add ``{prefix}_app_label/_source/_psp/_own_handle`` for the handle of an address column."""
    key = f"{prefix}_psp"
    dim = handles.select(
        F.col("handle").alias(key), F.col("label").alias("_label"), F.col("source").alias("_source"), F.col("own_handle").alias("_own")
    )
    joined = dim_join(df.withColumn(key, psp(F.col(address))), dim, key)
    return joined.withColumns(
        {
            f"{prefix}_app_label": F.when(F.col(key).isNull(), "No VPA").otherwise(
                F.coalesce("_label", F.concat(F.lit("Unknown TPAP (@"), F.col(key), F.lit(")")))
            ),
            f"{prefix}_app_source": F.col("_source"),
            f"{prefix}_own_handle": F.coalesce("_own", F.lit(False)),
        }
    ).drop("_label", "_source", "_own")


def resolve_bank(df: DataFrame, banks: DataFrame, bank_id: str = "bank_id", ifsc: str = "ifsc") -> DataFrame:
    """Add ``bank_name``: by bank id, by branch-code prefix, by full branch prefix, else a derived label."""
    master = banks.groupBy("bank_id").agg(F.min("bank_name").alias("_name"))
    by_prefix = banks.filter(F.col("ifsc_prefix") != "").groupBy("ifsc_prefix").agg(F.min("bank_name").alias("_by_full"))
    out = dim_join(df.withColumn("_code4", F.substring(F.col(ifsc), 1, 4)), master.select(F.col("bank_id").alias(bank_id), F.col("_name").alias("_by_id")), bank_id)
    out = dim_join(out, master.select(F.col("bank_id").alias("_code4"), F.col("_name").alias("_by_code")), "_code4")
    out = dim_join(out, by_prefix.withColumnRenamed("ifsc_prefix", ifsc), ifsc)
    return out.withColumn(
        "bank_name",
        F.coalesce(
            "_by_id", "_by_code", "_by_full",
            F.concat(filled(F.col("_code4")), F.lit(" Bank")),
            F.concat(filled(F.col(bank_id)), F.lit(" Bank")),
            F.lit(""),
        ),
    ).drop("_code4", "_by_id", "_by_code", "_by_full")


def direction_of_type(kind: Column) -> Column:
    """IN, OUT, META or UNKNOWN from the record type alone, by table and then by words in it."""
    upper = F.upper(kind)
    return F.coalesce(
        mapped(kind, TYPE_DIRECTION),
        F.when(upper.rlike("RECEIVED|CREDIT|REFUND"), "IN").when(upper.rlike("SENT|DEBIT|PAYMENT|BILL|RECHARGE"), "OUT"),
        F.lit("UNKNOWN"),
    )


def direction_of_legs(kind: Column, v: Column) -> Column:
    """IN, OUT, INTERNAL or UNKNOWN: the stated actor outranks the type unless the type says it outright."""
    actor = F.upper(F.trim(at(v, "actor")))
    stated = F.when(
        ~F.coalesce(kind, F.lit("")).isin(SELF_EVIDENT_TYPES),
        F.when(actor == "RECEIVER", "IN")
        .when(actor == "SENDER", "OUT")
        .when(Leg(v, "paymentPayerParty").stated(), "IN")
        .when(Leg(v, "paymentReceiver").stated(), "OUT"),
    )
    by_shape = F.when(Leg(v, "paidFrom").stated(), "OUT").when(Leg(v, "receivedIn").stated() | Leg(v, "from").stated(), "IN")
    return F.coalesce(stated, mapped(kind, LEG_TYPE_DIRECTION), by_shape, F.lit("UNKNOWN"))


def settlement_direction(kind: Column, direction: Column, payer_self: Column, payee_self: Column) -> Column:
    """Split settlements have no legs: the side on which only the owner stands decides."""
    return F.when(
        kind == "EXPENSE_SETTLEMENT",
        F.when(payer_self & ~payee_self, "OUT").when(payee_self & ~payer_self, "IN").otherwise(direction),
    ).otherwise(direction)


def direction_of_payment(kind: Column, v: Column) -> Column:
    """SENT, RECEIVED, SERVICE or UNKNOWN from transfer mode and leg presence, then from the type."""
    paid, received = Leg(v, "paidFrom").present(), Leg(v, "receivedIn").present()
    frm, to = Leg(v, "from", only_object=True).present(), Leg(v, "to").present()
    mode = F.upper(F.coalesce(at(v, "context.transferMode"), F.lit("")))
    return (
        F.when(mode.contains("INCOMING") | (frm & received), "RECEIVED")
        .when(paid & to, "SENT")
        .when(frm & to & ~paid, "RECEIVED")
        .when(kind == "RECEIVED_PAYMENT", "RECEIVED")
        .when(kind == "SENT_PAYMENT", "SENT")
        .when(kind.isin(SERVICE_TYPES), "SERVICE")
        .otherwise("UNKNOWN")
    )


def direction_of_ids(sender_id: Column, receiver_id: Column, sent: str = "SENT", received: str = "RECEIVED") -> Column:
    """Which of the two id columns is filled."""
    s, r = filled(sender_id).isNotNull(), filled(receiver_id).isNotNull()
    return F.when(s & ~r, sent).when(r & ~s, received).otherwise("UNKNOWN")


def payment_amount(v: Column) -> Column:
    """Paise: owner leg out, owner leg in, then the payload's own amount; zero when none."""
    def positive(c: Column) -> Column:
        return F.when(c != 0, c)

    paid, received = Leg(v, "paidFrom"), Leg(v, "receivedIn")
    return F.coalesce(
        positive(paid.amount()), positive(paid.amount("actualAmount")),
        positive(received.amount()), positive(received.amount("actualAmount")),
        positive(long_at(v, "amount")), positive(long_at(v, "amount.amount")), F.lit(0).cast("long"),
    )


def payment_state(state: Column, v: Column) -> Column:
    return F.coalesce(
        F.when(state == "ERRORED", "FAILED"), filled(state), F.upper(text_at(v, "paymentState")), F.lit("UNKNOWN")
    )


def user_note(v: Column) -> Column:
    """What the user typed: the context's message, else a text note or an object's message or text; lists are not notes."""
    some = lambda c: F.when(c != "", c)
    plain = F.when(kind_at(v, "note") == "STRING", at(v, "note"))
    note = F.coalesce(some(at(v, "context.message")), plain, some(at(v, "note.message")), some(at(v, "note.text")), F.lit(""))
    return F.regexp_replace(note, r"(?U)^\s+|\s+$", "")
