"""Document schemas: typed fields, who owns each, ontologies, and registry rules.

A field's owner is ``rule`` (patterns may resolve it) or ``model``.  Paths join nested
names with dots; ``[]`` marks a list of objects.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(),
    "decimal": T.DecimalType(38, 10), "date": T.DateType(),
}

#: Each schema's fields in order as path:type, '*' where patterns own the field.
_FIELDS = {
    "contract": "contract_type:str party_a:str party_b:str start_date:date* end_date:date* auto_renewal:bool liability_cap:decimal* jurisdiction:str",
    "conversation": "channel:str started_date:date* customer_name:str resolved:bool turns[].speaker:str turns[].text:str turns[].timestamp:str*",
    "crm_record": "contact_name:str company_name:str email:str* phone:str* deal_stage:str deal_value:decimal* probability:float owner:str last_contact_date:date*",
    "email": "sender_email:str* recipient_email:str* subject:str body:str sent_date:date* importance:str attachments_present:bool reply_needed:bool",
    "form": "form_id:str* submitted_date:date* submitter_name:str submitter_email:str* request_type:str details:str status:str priority:str",
    "insurance_claim": "claim_number:str* policy_number:str* claimant_name:str claim_type:str incident_date:date* amount_requested:decimal* status:str involved_parties[].name:str involved_parties[].role:str",
    "invoice": "invoice_number:str* invoice_date:date* due_date:date* vendor_name:str vendor_email:str* vendor_phone:str* total_amount:decimal* tax_amount:decimal* line_items[].description:str line_items[].quantity:decimal* line_items[].unit_price:decimal* line_items[].line_total:decimal*",
    "kg_triple": "subject:str predicate:str object:str subject_type:str object_type:str context:str confidence:float extracted_date:date*",
    "medical_note": "patient_name:str patient_age:int visit_date:date* diagnosis:str physician_name:str medications[].name:str medications[].dosage:str follow_up_date:date*",
    "receipt": "receipt_number:str* receipt_date:date* store_name:str cashier_name:str total_amount:decimal* tax_amount:decimal* payment_method:str refunded:bool line_items[].description:str line_items[].quantity:decimal* line_items[].unit_price:decimal* line_items[].line_total:decimal*",
    "resume": "candidate_name:str email:str* phone:str* job_title:str years_experience:float highest_degree:str current_employer:str location:str",
    "support_ticket": "ticket_id:str* created_date:date* intent:str issue_category:str product:str urgency:str sentiment:str resolution_status:str customer_email:str*",
}
_HELD_OUT = ("conversation", "insurance_claim", "kg_triple")
_COMPANY = {"Corp.": "Corporation", "Inc.": "Incorporated", "Intl.": "International", "Tech.": "Technologies"}
#: Surface forms and what they stand for; the first of equal forms counts.
_ONTOLOGY = {
    "contract": {"MSA": "Master Services Agreement", "NDA": "Non-Disclosure Agreement", "SLA": "Software License Agreement"},
    "crm_record": _COMPANY,
    "insurance_claim": {
        "car accident": "Auto Collision", "auto collision": "Auto Collision", "fender bender": "Auto Collision", "house fire": "Fire",
        "kitchen fire": "Fire", "burst pipe": "Water Damage", "flood": "Water Damage", "slip and fall": "Liability", "theft": "Theft", "stolen": "Theft",
    },
    "invoice": _COMPANY,
    "medical_note": {
        "HTN": "Hypertension", "htn": "Hypertension", "DM2": "Type 2 Diabetes Mellitus", "T2DM": "Type 2 Diabetes Mellitus",
        "MI": "Myocardial Infarction", "CHF": "Congestive Heart Failure", "COPD": "Chronic Obstructive Pulmonary Disease",
        "CKD": "Chronic Kidney Disease", "PUD": "Peptic Ulcer Disease",
    },
    "receipt": _COMPANY,
    "resume": _COMPANY,
}


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    owner: str

    @property
    def repeated(self) -> bool:
        return "[]" in self.path


@dataclass(frozen=True)
class Schema:
    """A document schema; its fields are each owned once, and the paths are unique."""

    name: str
    fields: tuple[Field, ...]
    ontology: dict[str, str] = field(default_factory=dict)
    held_out: bool = False

    def __post_init__(self) -> None:
        paths = [f.path for f in self.fields]
        if len(set(paths)) != len(paths):
            raise ValueError(f"{self.name}: a path is declared twice")
        if bad := [f for f in self.fields if f.type not in TYPES or f.owner not in ("rule", "model")]:
            raise ValueError(f"{self.name}: unknown type or owner: {bad}")

    def paths(self, owner: str | None = None) -> list[str]:
        return sorted(f.path for f in self.fields if owner in (None, f.owner))

    def struct(self) -> T.StructType:
        """The Spark type of a gold record."""
        out, lists = T.StructType(), {}
        for f in self.fields:
            if f.repeated:
                parent, _, leaf = f.path.partition("[].")
                if parent not in lists:
                    lists[parent] = T.StructType()
                    out.add(parent, T.ArrayType(lists[parent]))
                lists[parent].add(leaf, TYPES[f.type])
            else:
                out.add(f.path, TYPES[f.type])
        return out


def leaf_paths(kind: T.StructType, prefix: str = "") -> list[str]:
    """Leaf paths of any Spark struct, sorted."""
    out: list[str] = []
    for f in kind.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += leaf_paths(f.dataType, path)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += leaf_paths(f.dataType.elementType, f"{path}[]")
        else:
            out.append(path)
    return sorted(out)


_REGISTRY: dict[str, Schema] = {}


def register(schema: Schema) -> None:
    """Add a schema; a name can be registered once."""
    if schema.name in _REGISTRY:
        raise ValueError(f"schema {schema.name!r} is already registered")
    _REGISTRY[schema.name] = schema


def get_schema(name: str) -> Schema:
    if name not in _REGISTRY:
        raise KeyError(f"unknown schema {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def schemas(held_out: bool | None = None) -> list[Schema]:
    """Registered schemas by name: all, held-out ones, or those for training."""
    return [s for _, s in sorted(_REGISTRY.items()) if held_out in (None, s.held_out)]


def split_schemas(names: list[str], split: str = "any") -> list[str]:
    """The schemas to use for a split; a training split never has held-out ones."""
    if split not in ("train", "eval", "any"):
        raise ValueError(f"split must be 'train', 'eval' or 'any', not {split!r}")
    if split == "train" and (bad := sorted({s.name for s in schemas(True)} & set(names))):
        raise ValueError(f"held-out schemas in a training split: {', '.join(bad)}")
    if not names:
        names = [s.name for s in schemas({"train": False, "eval": True, "any": None}[split])]
    return sorted(get_schema(n).name for n in names)


def field_dim(spark: SparkSession) -> DataFrame:
    """(schema, path, type, owner, repeated): one row a declared leaf."""
    rows = [(s.name, f.path, f.type, f.owner, f.repeated) for s in schemas() for f in s.fields]
    return spark.createDataFrame(rows, "schema string, path string, type string, owner string, repeated boolean")


def schema_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.held_out) for s in schemas()], "schema string, held_out boolean")


def ontology_dim(spark: SparkSession) -> DataFrame:
    """(schema, surface, canonical): surface trimmed and lower-cased, the first entry of each."""
    rows: dict[tuple[str, str], str] = {}
    for s in schemas():
        for surface, canonical in s.ontology.items():
            rows.setdefault((s.name, surface.strip().lower()), canonical)
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "schema string, surface string, canonical string")


for _name, _text in _FIELDS.items():
    _parts = [x.rstrip("*").split(":") + ["rule" if x.endswith("*") else "model"] for x in _text.split()]
    register(Schema(_name, tuple(Field(*x) for x in _parts), _ONTOLOGY.get(_name, {}), _name in _HELD_OUT))
