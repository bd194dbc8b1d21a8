"""Synthetic documents with known gold, as Column expressions over record ids.

A seed is a text and gold fields over named slots.  A slot draws from a digest of (seed,
record id, slot), so a record is the same whatever the partitioning, and SQL over the same
seed can repeat it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import get_schema, schemas

FIRST = ["Ingrid", "Tobias", "Leila", "Marcin", "Yuki", "Brendan", "Salome", "Arjun", "Freya", "Kwame", "Noor", "Dmitri"]
LAST = ["Abernathy", "Lindqvist", "Moreau", "Tanaka", "Oyelaran", "Castellano", "Novak", "Whitlock", "Haddad", "Rasmussen", "Vieira", "Petrov"]
GOODS = ["Torque Wrench", "Ceramic Bearing", "Hydraulic Seal", "Voltage Regulator", "Steel Bracket", "Conveyor Roller", "Thermal Sensor"]
GROCERIES = ["Rye Loaf", "Goat Cheese", "Plum Jam", "Green Lentils", "Sparkling Water", "Basmati Rice", "Dark Chocolate"]
PRICES = ["3.25", "8.40", "17.95", "42.10", "128.65", "310.80", "1249.99"]
#: Canonical forms of the ontology of medical notes.
DIAGNOSES = [
    "Hypertension", "Type 2 Diabetes Mellitus", "Myocardial Infarction", "Congestive Heart Failure", "Chronic Kidney Disease",
    "Chronic Obstructive Pulmonary Disease", "Peptic Ulcer Disease",
]
DOCTORS = ["Dr. Eklund", "Dr. Baptiste", "Dr. Okonkwo", "Dr. Hallström", "Dr. Menon"]
DRUGS = [("ramipril", "5 mg"), ("gliclazide", "80 mg"), ("rosuvastatin", "10 mg"), ("bisoprolol", "2 mg"), ("furosemide", "40 mg"), ("apixaban", "5 mg")]
VENDORS = [
    ("Halvorsen Tools International", "ledger@halvorsen.example", "+1 (312) 555-2841"), ("Brightwater Corporation", "invoices@brightwater.example", "+1 (503) 555-3972"),
    ("Kestrel Technologies", "accounts@kestrel.example", "+1 (617) 555-4410"), ("Pinecrest Supply Incorporated", "billing@pinecrest.example", "+1 (702) 555-6128"),
]
SHOPS = ["Harbour Street Deli", "Old Mill Market", "Corner Pantry", "Sunrise Provisions", "Lakeside Grocer"]
CASHIERS = ["Wanda", "Idris", "Chiara", "Pavel", "Nadia"]
PAYMENTS = ["Gift Card", "Contactless", "Banknotes", "Store Credit"]
TITLES = ["Site Reliability Engineer", "Actuary", "Hydrologist", "Technical Writer", "Supply Planner"]
DEGREES = ["Diploma in Engineering", "Master of Arts", "Doctorate in Chemistry", "Bachelor of Commerce"]
EMPLOYERS = ["Tidewater Analytics", "Granite Peak Robotics", "Marlowe Logistics", "Juniper Diagnostics"]
CITIES = ["Tampa, FL", "Boise, ID", "Omaha, NE", "Tucson, AZ", "Albany, NY"]
#: The first three are canonical forms of the ontology of contracts.
AGREEMENTS = ["Software License Agreement", "Non-Disclosure Agreement", "Master Services Agreement", "Equipment Lease", "Distribution Agreement"]
COMPANIES = ["Larkspur Holdings", "Ironbridge Capital", "Solstice Foods", "Meridian Freight", "Cobalt Optics"]
PARTNERS = ["Wren Studios", "Hazelnut Media", "Quarry Labs", "Saffron Systems"]
COURTS = ["State of Oregon", "State of Ohio", "State of Nevada", "Province of Ontario"]
INTENTS = ["Replacement", "Warranty Claim", "Invoice Copy", "Address Change", "Upgrade"]
TOPICS = ["Shipping", "Firmware", "Account", "Warranty"]
DEVICES = ["Aurora Lamp", "Nimbus Router", "Pulse Watch", "Terra Kettle"]
GRADES = ["Critical", "Ordinary", "Minor"]
MOODS = ["Calm", "Annoyed", "Grateful", "Worried"]
OUTCOMES = ["Solved", "Handed over", "Waiting", "Withdrawn"]
#: Canonical forms of the ontology of insurance claims.
LOSSES = ["Auto Collision", "Fire", "Water Damage", "Theft", "Liability"]
DECISIONS = ["Registered", "In assessment", "Paid out", "Refused"]
ROLES = ["Bystander", "Second motorist", "Tenant", "Neighbour"]
STAGES = ["First talk", "Demo held", "Offer sent", "Signed", "Dropped"]
CHANCES = ["0.15", "0.35", "0.55", "0.85"]
OWNERS = ["Marta", "Jonas", "Ebele", "Ruth"]
SUBJECTS = ["Minutes of the site visit", "Parking permits for March", "Draft of the safety manual", "Change of the delivery slot"]
BODIES = [
    "I have put the minutes of last week's visit in the shared folder, with photographs.", "Permits can be collected at the front desk from Monday on.",
    "Chapter four of the manual still lacks the drawings for the new press.", "The haulier asks whether the pallets can leave an hour earlier.",
]
WEIGHTS = ["Urgent", "Routine", "Whenever convenient"]
CHANNELS = ["Hotline", "Web chat", "Text message"]
LINES = [
    "The kettle switches itself off after a minute.", "Which firmware does the router show?", "I can read out the serial number.", "We will send a courier tomorrow.",
    "The parcel went to my previous flat.", "That fixed it, many thanks.", "Please hold while I look that up.", "Could you spell the street for me?",
]
REQUESTS = ["Key Card", "Equipment Loan", "Room Booking", "Travel Advance", "Training Place"]
REASONS = [
    "The night shift needs a second card for the cold store.", "Two tripods are wanted for the survey of the east bank.",
    "The projector in the large hall has to be reserved for the fair.", "A place on the forklift course opened up at short notice.",
]
STATES = ["Received", "With the office", "Granted", "Sent back"]
FACTS = [
    ("Larkspur Holdings", "owns", "Wren Studios"), ("Ironbridge Capital", "finances", "Quarry Labs"),
    ("Solstice Foods", "buys from", "Meridian Freight"), ("Cobalt Optics", "licenses", "Saffron Systems"),
]
KINDS = ["Company", "Laboratory", "Carrier", "Publisher"]
ORIGINS = ["Named in the prospectus of the last share issue.", "Taken from the minutes of the shareholders' meeting.", "Found in the register of commerce."]
CERTAINTIES = ["0.65", "0.75", "0.85", "0.92"]
SPEAKERS = ("Caller", "Desk")
TAX_PERCENT = 7


@dataclass(frozen=True)
class Pick:
    """One of some strings; ``unlike`` names a slot with the same options whose string it is not."""

    options: Sequence[str]
    unlike: str = ""


@dataclass(frozen=True)
class Row:
    """One of some rows; its parts are slot.0, slot.1 and so on."""

    options: Sequence[tuple[str, ...]]


@dataclass(frozen=True)
class Number:
    """A whole number from low to high, both included."""

    low: int
    high: int


@dataclass(frozen=True)
class Day:
    """A date in two years, or some days after another slot's."""

    after: str = ""
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class Chance:
    """true or false."""

    share: float


@dataclass(frozen=True)
class Text:
    """Other slots put together."""

    template: str


@dataclass(frozen=True)
class Items:
    """One to three line items; parts: text, gold, subtotal, tax, total."""

    names: Sequence[str]
    most: int


@dataclass(frozen=True)
class Turns:
    """Turns of a talk; parts: text, gold."""

    lines: Sequence[str]
    low: int
    high: int


@dataclass(frozen=True)
class Raw:
    """A gold value that is no JSON string."""

    slot: str


Slot = Pick | Row | Number | Day | Chance | Text | Items | Turns


@dataclass(frozen=True)
class Seed:
    """slots in the order in which they may name each other; gold by path."""

    slots: dict[str, Slot]
    text: str
    gold: dict[str, str | Raw]


_PERSON = {"first": Pick(FIRST), "last": Pick(LAST), "who": Text("{first} {last}")}

SEEDS = {
    "medical_note": Seed(
        _PERSON | {"age": Number(19, 94), "visit": Day(), "back": Day("visit", 14, 60), "finding": Pick(DIAGNOSES), "doctor": Pick(DOCTORS), "drug": Row(DRUGS)},
        "Clinic note for {who}, {age} years of age.\nVisit date: {visit}\nFinding: {finding}\nPhysician on duty: {doctor}\nPrescription: {drug.0} at {drug.1}\nFollow-up on {back} unless symptoms return.",
        {
            "patient_name": "who", "patient_age": Raw("age"), "visit_date": "visit", "diagnosis": "finding", "physician_name": "doctor",
            "medications[].name": "drug.0", "medications[].dosage": "drug.1", "follow_up_date": "back",
        },
    ),
    "invoice": Seed(
        {"n": Number(1000, 9999), "number": Text("INV-{n}"), "issued": Day(), "due": Day("issued", 10, 45), "vendor": Row(VENDORS), "items": Items(GOODS, 6)},
        "Bill {number}\nDate of issue: {issued}\nDue by: {due}\nVendor: {vendor.0}, {vendor.1}, {vendor.2}\n{items.text}\nSubtotal: ${items.subtotal}\nTax: ${items.tax}\nTotal due: ${items.total}",
        {
            "invoice_number": "number", "invoice_date": "issued", "due_date": "due", "vendor_name": "vendor.0", "vendor_email": "vendor.1", "vendor_phone": "vendor.2",
            "total_amount": "items.total", "tax_amount": "items.tax", "line_items": Raw("items.gold"),
        },
    ),
    "receipt": Seed(
        {
            "n": Number(10000, 99999), "number": Text("REC-{n}"), "day": Day(), "shop": Pick(SHOPS), "cashier": Pick(CASHIERS), "payment": Pick(PAYMENTS),
            "back": Chance(0.2), "items": Items(GROCERIES, 4),
        },
        "{shop}\nReceipt {number}, printed {day}\nServed by: {cashier}\n{items.text}\nSubtotal: ${items.subtotal}\nTax: ${items.tax}\nTotal paid: ${items.total}\nSettled with: {payment}{back?\nThe goods came back and the money was returned.}",
        {
            "receipt_number": "number", "receipt_date": "day", "store_name": "shop", "cashier_name": "cashier", "total_amount": "items.total",
            "tax_amount": "items.tax", "payment_method": "payment", "refunded": Raw("back"), "line_items": Raw("items.gold"),
        },
    ),
    "resume": Seed(
        _PERSON | {
            "n": Number(1000, 9999), "email": Text("{first.low}.{last.low}@mailbox.example"), "phone": Text("+1 (415) 555-{n}"), "title": Pick(TITLES),
            "years": Number(2, 30), "degree": Pick(DEGREES), "employer": Pick(EMPLOYERS), "city": Pick(CITIES),
        },
        "{who}\nRole: {title}\nReach me at {email} or {phone}.\nExperience: {years} years\nEducation: {degree}\nWorks at: {employer}\nLives in: {city}",
        {
            "candidate_name": "who", "email": "email", "phone": "phone", "job_title": "title", "years_experience": Raw("years"),
            "highest_degree": "degree", "current_employer": "employer", "location": "city",
        },
    ),
    "contract": Seed(
        {
            "kind": Pick(AGREEMENTS), "a": Pick(COMPANIES), "b": Pick(PARTNERS), "start": Day(), "end": Day("start", 120, 1100), "renews": Chance(0.3),
            "n": Number(2, 40), "cap": Text("{n}50000.00"), "court": Pick(COURTS),
        },
        "{kind}\nParties: {a} and {b}\nStart date: {start}\nEnd date: {end}\nLiability limit: ${cap}\nCourts of: {court}{renews?\nUnless cancelled, it is prolonged by itself.}",
        {
            "contract_type": "kind", "party_a": "a", "party_b": "b", "start_date": "start", "end_date": "end", "auto_renewal": Raw("renews"),
            "liability_cap": "cap", "jurisdiction": "court",
        },
    ),
    "support_ticket": Seed(
        {
            "n": Number(10000, 99999), "number": Text("TKT-{n}"), "day": Day(), "first": Pick(FIRST), "email": Text("{first.low}@household.example"), "intent": Pick(INTENTS),
            "topic": Pick(TOPICS), "device": Pick(DEVICES), "grade": Pick(GRADES), "mood": Pick(MOODS), "outcome": Pick(OUTCOMES),
        },
        "Ticket {number}, created {day}\nCustomer: {email}\nWants: {intent}\nTopic: {topic}\nProduct: {device}\nUrgency: {grade}\nMood: {mood}\nOutcome: {outcome}",
        {
            "ticket_id": "number", "created_date": "day", "customer_email": "email", "intent": "intent", "issue_category": "topic", "product": "device",
            "urgency": "grade", "sentiment": "mood", "resolution_status": "outcome",
        },
    ),
    "insurance_claim": Seed(
        _PERSON | {
            "n": Number(10000, 99999), "number": Text("CLM-{n}"), "m": Number(1000, 9999), "policy": Text("POL-{m}"), "loss": Pick(LOSSES), "day": Day(),
            "tens": Number(2, 60), "amount": Text("{tens}500.00"), "decision": Pick(DECISIONS), "first2": Pick(FIRST, "first"), "last2": Pick(LAST), "other": Text("{first2} {last2}"), "role": Pick(ROLES),
        },
        "Claim {number} under policy {policy}\nFiled by: {who}\nKind of loss: {loss}\nIncident on {day}\nAmount sought: ${amount}\nDecision: {decision}\nAlso involved: {other} as {role}",
        {
            "claim_number": "number", "policy_number": "policy", "claimant_name": "who", "claim_type": "loss", "incident_date": "day", "amount_requested": "amount",
            "status": "decision", "involved_parties[].name": "other", "involved_parties[].role": "role",
        },
    ),
    "crm_record": Seed(
        _PERSON | {
            "company": Pick(COMPANIES), "email": Text("{first.low}@{company.low}.example"), "n": Number(1000, 9999), "phone": Text("+1 (206) 555-{n}"), "stage": Pick(STAGES),
            "tens": Number(3, 80), "value": Text("{tens}250.00"), "chance": Pick(CHANCES), "owner": Pick(OWNERS), "day": Day(),
        },
        "Lead: {who} of {company}\nReach at: {email}, {phone}\nPipeline step: {stage}\nDeal value: ${value}\nChance of closing: {chance}\nLooked after by: {owner}\nLast contact: {day}",
        {
            "contact_name": "who", "company_name": "company", "email": "email", "phone": "phone", "deal_stage": "stage", "deal_value": "value",
            "probability": Raw("chance"), "owner": "owner", "last_contact_date": "day",
        },
    ),
    "email": Seed(
        {
            "first": Pick(FIRST), "first2": Pick(FIRST, "first"), "sender": Text("{first.low}@office.example"), "to": Text("{first2.low}@office.example"), "subject": Pick(SUBJECTS),
            "body": Pick(BODIES), "day": Day(), "weight": Pick(WEIGHTS), "files": Chance(0.5), "reply": Chance(0.5),
        },
        "From: {sender}\nTo: {to}\nSent: {day}\nSubject: {subject}\nWeight: {weight}\n\n{body}\n\n{files?Files are enclosed.:Nothing is enclosed.} {reply?Kindly write back.:No reply is due.}",
        {
            "sender_email": "sender", "recipient_email": "to", "subject": "subject", "body": "body", "sent_date": "day", "importance": "weight",
            "attachments_present": Raw("files"), "reply_needed": Raw("reply"),
        },
    ),
    "conversation": Seed(
        _PERSON | {"channel": Pick(CHANNELS), "day": Day(), "solved": Chance(0.5), "turns": Turns(LINES, 2, 5)},
        "{channel} log, started {day}\nIn talks with: {who}\nSolved: {solved?yes:no}\n{turns.text}",
        {"channel": "channel", "started_date": "day", "customer_name": "who", "resolved": Raw("solved"), "turns": Raw("turns.gold")},
    ),
    "form": Seed(
        _PERSON | {
            "n": Number(10000, 99999), "number": Text("FRM-{n}"), "day": Day(), "email": Text("{first.low}.{last.low}@works.example"), "request": Pick(REQUESTS),
            "reason": Pick(REASONS), "state": Pick(STATES), "grade": Pick(GRADES),
        },
        "Form {number}\nSubmitted on: {day}\nSubmitter: {who}, {email}\nAsks for: {request}\nReason: {reason}\nState: {state}\nRank: {grade}",
        {
            "form_id": "number", "submitted_date": "day", "submitter_name": "who", "submitter_email": "email", "request_type": "request", "details": "reason",
            "status": "state", "priority": "grade",
        },
    ),
    "kg_triple": Seed(
        {"fact": Row(FACTS), "a": Pick(KINDS), "b": Pick(KINDS), "origin": Pick(ORIGINS), "sure": Pick(CERTAINTIES), "day": Day()},
        "Extracted {day}\nFact: {fact.0} {fact.1} {fact.2}\nKinds: {a} and {b}\nOrigin: {origin}\nCertainty: {sure}",
        {
            "subject": "fact.0", "predicate": "fact.1", "object": "fact.2", "subject_type": "a", "object_type": "b", "context": "origin",
            "confidence": Raw("sure"), "extracted_date": "day",
        },
    ),
}

#: What stands before a colon at the start of a line of some text.
LABELS = sorted({m for s in SEEDS.values() for m in re.findall(r"(?m)^([A-Z][A-Za-z ]*):", s.text)})
BITS = 52
#: Records of a task; schemas differ in what a record takes, and a corpus has them one after the other.
TASK_RECORDS = 2_500


class Draws:
    """Seeded draws for one record id column."""

    def __init__(self, record_id: Column, seed: int):
        self.id, self.seed = record_id, seed

    def _number(self, name: tuple[str | Column, ...]) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), self.id, *[F.lit(x) if isinstance(x, str) else x for x in name]), F.lit(1 << BITS))

    def below(self, n: Column | int, *name: str | Column) -> Column:
        return F.pmod(self._number(name), F.lit(n) if isinstance(n, int) else n).cast("int")

    def unit(self, *name: str | Column) -> Column:
        return self._number(name) / F.lit(float(1 << BITS))

    def pick(self, options: Sequence[str], *name: str | Column) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), self.below(len(options), *name) + 1)


class DigestDraws(Draws):
    """Draws from the first 52 bits of the MD5 digest of ``seed:id:name:...``, which any engine has."""

    def _number(self, name: tuple[str | Column, ...]) -> Column:
        parts = [F.lit(str(self.seed)), self.id.cast("string"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in name]]
        return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def _money(x: Column) -> Column:
    return F.bround(x, 2).cast("decimal(12,2)").cast("string")


def _items(d: Draws, name: str, items: Items) -> dict[str, Column]:
    def item(i: Column) -> Column:
        what, price = d.pick(items.names, name, "what", i), d.pick(PRICES, name, "price", i)
        return F.struct(what.alias("what"), (d.below(items.most, name, "n", i) + 1).alias("n"), price.alias("price"))

    found = F.transform(F.sequence(F.lit(0), d.below(3, name, "count")), item)
    total = lambda x: x["n"].cast("decimal(12,2)") * x["price"].cast("decimal(12,2)")
    text = F.transform(found, lambda x: F.concat(x["what"], F.lit(" x "), x["n"].cast("string"), F.lit(" @ $"), x["price"], F.lit(" = $"), _money(total(x))))
    gold = F.transform(found, lambda x: F.struct(x["what"].alias("description"), _money(total(x)).alias("line_total"), x["n"].alias("quantity"), x["price"].alias("unit_price")))
    subtotal = F.aggregate(found, F.lit(0).cast("decimal(14,2)"), lambda a, x: (a + total(x)).cast("decimal(14,2)"))
    tax = F.bround(subtotal * F.lit(TAX_PERCENT) / F.lit(100), 2).cast("decimal(14,2)")
    return {"text": F.array_join(text, "\n"), "gold": F.to_json(gold), "subtotal": _money(subtotal), "tax": _money(tax), "total": _money(subtotal + tax)}


def _turns(d: Draws, name: str, turns: Turns) -> dict[str, Column]:
    def turn(i: Column) -> Column:
        at = F.format_string("%02d:%02d", d.below(10, name, "h", i) + 8, d.below(60, name, "m", i))
        return F.struct(F.when(i % 2 == 0, SPEAKERS[0]).otherwise(SPEAKERS[1]).alias("speaker"), d.pick(turns.lines, name, "t", i).alias("text"), at.alias("timestamp"))

    found = F.transform(F.sequence(F.lit(1), d.below(turns.high - turns.low + 1, name, "count") + turns.low), turn)
    text = F.transform(found, lambda t: F.concat(F.lit("["), t["timestamp"], F.lit("] "), t["speaker"], F.lit(" - "), t["text"]))
    return {"text": F.array_join(text, "\n"), "gold": F.to_json(found)}


def _slots(slots: dict[str, Slot], d: Draws) -> dict[str, Column]:
    """Columns by slot, and by slot.part where a slot has parts; slot.low is a string's first word in lower case."""
    out: dict[str, Column] = {}
    for name, slot in slots.items():
        match slot:
            case Pick(options, ""):
                out[name] = d.pick(options, name)
            case Pick(options, other):
                left = F.array_remove(F.array(*[F.lit(o) for o in options]), out[other])
                out[name] = F.element_at(left, d.below(len(options) - 1, name) + 1)
            case Row(options):
                at = d.below(len(options), name) + 1
                for i, part in enumerate(zip(*options, strict=True)):
                    out[f"{name}.{i}"] = F.element_at(F.array(*[F.lit(x) for x in part]), at)
            case Number(low, high):
                out[name] = (d.below(high - low + 1, name) + low).cast("string")
            case Day("", _, _):
                out[name] = F.make_date(d.below(2, name, "y") + 2025, d.below(12, name, "m") + 1, d.below(28, name, "d") + 1).cast("string")
            case Day(other, low, high):
                out[name] = F.date_add(out[other].cast("date"), d.below(high - low + 1, name) + low).cast("string")
            case Chance(share):
                out[name] = F.when(d.unit(name) < share, "true").otherwise("false")
            case Text(template):
                out[name] = _render(template, out)
            case Items():
                out |= {f"{name}.{part}": c for part, c in _items(d, name, slot).items()}
            case Turns():
                out |= {f"{name}.{part}": c for part, c in _turns(d, name, slot).items()}
        if isinstance(slot, Pick):
            out[f"{name}.low"] = F.lower(F.split(out[name], " ")[0])
    return out


def pieces(template: str) -> list[tuple[str, str, str, str]]:
    """A template as (literal, slot, text if true, text if false): {slot}, {flag?text} or {flag?text:other}."""
    out = []
    for literal, inside in re.findall(r"([^{]*)(?:\{([^}]*)\})?", template):
        flag, _, rest = inside.partition("?")
        yes, _, no = rest.partition(":")
        if literal or inside:
            out.append((literal, flag, yes, no))
    return out


def _render(template: str, slots: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for literal, slot, yes, no in pieces(template):
        parts += [F.lit(literal)] if literal else []
        if slot:
            parts.append(F.when(slots[slot] == "true", yes).otherwise(no) if yes or no else slots[slot])
    return F.concat(*parts)


def gold_shape(gold: dict[str, str | Raw]) -> list[tuple[str, list[tuple[str, str | Raw]] | str | Raw]]:
    """Keys in order with their slot, or with the leaves of the one object of a list."""
    flat: dict[str, str | Raw] = {}
    lists: dict[str, list[tuple[str, str | Raw]]] = {}
    for path, slot in sorted(gold.items()):
        parent, many, leaf = path.partition("[].")
        if many:
            lists.setdefault(parent, []).append((leaf, slot))
        else:
            flat[path] = slot
    return sorted((flat | lists).items())


def _gold(gold: dict[str, str | Raw], slots: dict[str, Column]) -> Column:
    """The gold as JSON with keys in order at every level."""

    def value(slot: str | Raw) -> list[Column]:
        return [slots[slot.slot]] if isinstance(slot, Raw) else [F.lit('"'), slots[slot], F.lit('"')]

    parts: list[Column] = []
    for i, (key, slot) in enumerate(gold_shape(gold)):
        parts.append(F.lit(("{" if i == 0 else ",") + f'"{key}":'))
        if isinstance(slot, list):
            for j, (leaf, of) in enumerate(slot):
                parts += [F.lit(("[{" if j == 0 else ",") + f'"{leaf}":'), *value(of)]
            parts.append(F.lit("}]"))
        else:
            parts += value(slot)
    return F.concat(*parts, F.lit("}"))


def seed_columns(schema: str, record_id: Column, seed: int = 0) -> tuple[Column, Column]:
    """The text and the gold JSON of a schema's document for each record id."""
    get_schema(schema)
    if schema not in SEEDS:
        raise KeyError(f"no seed for schema {schema!r}")
    one = SEEDS[schema]
    columns = _slots(one.slots, DigestDraws(record_id, seed))
    return _render(one.text, columns), _gold(one.gold, columns)


def numbered(spark: SparkSession, first: int, n: int) -> DataFrame:
    """id from ``first`` on, in at least as many tasks as there are cores, of at most ``TASK_RECORDS`` records."""
    return spark.range(first, first + n, 1, max(spark.sparkContext.defaultParallelism, -(-n // TASK_RECORDS)))


def seeds(spark: SparkSession, schema: str, n: int, seed: int = 0, first: int = 0) -> DataFrame:
    """record_id, schema, source_text, reference (JSON), for n records from ``first`` on."""
    text, gold = seed_columns(schema, F.col("id"), seed)
    return numbered(spark, first, n).select(F.col("id").alias("record_id"), F.lit(schema).alias("schema"), text.alias("source_text"), gold.alias("reference"))


def missing_seeds() -> list[str]:
    """Registered schemas without a seed."""
    return [s.name for s in schemas() if s.name not in SEEDS]
