"""Older ways to protect texts: entities given by a caller, labels of lines, and tokens for what a policy keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions.scalars import transformed
from wardloom.operators.spans import greedy, located, rewritten
from wardloom.operators.terms import protected_matches, restored
from wardloom.plans.protect import actions, policy_rows, target

__all__ = ["by_entities", "by_labels", "kept_protected", "placeholders_protected", "restored", "transformed_text"]

# Labels of lines, by the type of what follows their colon.
LABELLED = [
    ("patient_name", r"Patient(?:\s+Name)?"), ("physician_name", r"(?:Authorized\s+By|Authorized\s+Physician|Attending\s+Physician|Referring\s+Physician|Physician|Doctor)"), ("civil_id", r"Civil\s+ID"), ("mrn", "MRN"),
    ("visit_number", r"(?:Emergency\s+)?Visit\s+Number"), ("lab_number", r"Lab(?:oratory)?\s+Number"), ("accession_number", r"Accession\s+Number"), ("specimen_number", r"Specimen\s+Number"), ("insurance_number", r"Insurance\s+Number"),
    ("document_id", r"Document\s+ID"), ("phone_number", r"(?:Phone|Telephone|Mobile)\s*(?:Number)?"), ("email", "Email"), ("address", "Address"), ("date_of_birth", r"(?:Date\s+of\s+Birth|DOB)"),
    ("admission_date", r"Admission\s+Date"), ("discharge_date", r"Discharge\s+Date"), ("exam_date", r"Exam(?:ination)?\s+Date"), ("collection_date", r"Collection\s+(?:Date|Time)"),
]
# What is kept from other engines if a policy keeps its type: names of physicians, hospitals, departments, and lines with a role.
NAME = r"[A-Z][A-Za-z'-]+"
KEPT = [
    ("physician_name", rf"\bDr\.?\s+{NAME}(?:\s+{NAME}){{1,3}}\b"), ("organization", r"\b[A-Z][A-Za-z&.' -]+\s+Hospital\b"), ("organization", r"\b[A-Z][A-Za-z&.' -]+\s+Medical Center\b"),
    ("department", r"(?imd)^(?:Pathology|Radiology|Laboratory|Emergency|Cardiology|Surgery|Oncology)\s+Department$"),
    ("physician_name", r"(?imd)^(?:Consultant Pathologist|Consultant Radiologist|Reporting Physician|Attending Physician|Referring Physician)$"),
]
PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*(?::[^\[\]\r\n]+)?\]"
PLACEHOLDER_TOKEN, KEEP_TOKEN = "__PLACEHOLDER_%04d__", "__KEEP_%04d__"


def action_of(profile: str, kind: str) -> str:
    """The action of a policy for a type; what it doesn't name is kept."""
    return next((a for p, t, a in policy_rows() if (p, t) == (profile, kind)), "keep")


def by_entities(text: Column, entities: Column, profile: str) -> Column:
    """``text`` with the entities of an array of structs (entity, value, start, end) transformed by a policy.

    Entities whose offsets hold their value are replaced there, the longest of those that overlap; of the others the first
    place where the value stands is. Types that the policy keeps stay, and so do nulls and repetitions.
    """
    known = F.transform(F.coalesce(entities, F.array().cast("array<struct<entity:string,value:string,start:int,end:int>>")), lambda x: F.struct(target(x["entity"]).alias("kind"), x["value"].alias("value"), x["start"].cast("int").alias("start_pos"), x["end"].cast("int").alias("end_pos")))
    acted = F.array_distinct(F.filter(known, lambda x: x["kind"].isNotNull() & (F.length(x["value"]) > 0) & (actions(profile, x["kind"]) != "keep")))
    placed = lambda x: F.coalesce((x["start_pos"] >= 0) & (x["end_pos"] > x["start_pos"]) & (F.substring(text, x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["value"]), F.lit(False))
    made = lambda x: transformed(F.trim(x["value"]), x["kind"], actions(profile, x["kind"]))
    ordered = F.array_sort(F.transform(F.filter(acted, placed), lambda x: F.struct((x["start_pos"] - x["end_pos"]).alias("w"), x["start_pos"], x["end_pos"], made(x).alias("replacement"))))
    done = rewritten(text, greedy(ordered))
    loose = F.array_distinct(F.transform(F.filter(acted, lambda x: ~placed(x)), lambda x: F.struct(x["value"].alias("value"), made(x).alias("replacement"))))

    def first_place(a: Column, x: Column) -> Column:
        at = F.instr(a, x["value"])
        return F.when(at > 0, F.concat(F.substring(a, F.lit(1), at - 1), x["replacement"], F.substring(a, at + F.length(x["value"]), F.length(a)))).otherwise(a)

    return F.aggregate(loose, done, first_place)


def by_labels(text: Column, profile: str) -> Column:
    """``text`` with what follows the labels of lines transformed by a policy, one label after another."""
    out = text
    for kind, label in LABELLED:
        act = action_of(profile, kind)
        if act != "keep":
            out = _labelled(out, rf"(?imd)({label}\s*:\s*)([^\r\n]+)", kind, act)
    return out


def _labelled(text: Column, pattern: str, kind: str, act: str) -> Column:
    one = lambda t: rewritten(t, F.transform(located(t, pattern, 1, 2), lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), transformed(F.trim(x["value"]), F.lit(kind), F.lit(act)).alias("replacement"))))
    return F.element_at(F.transform(F.array(text), one), 1)  # the text so far is worked out once


def transformed_text(text: Column, entities: Column, profile: str) -> Column:
    """By entities where there are any, else by labels."""
    return F.when(F.length(text) == 0, text).when(F.size(F.coalesce(entities, F.array())) > 0, by_entities(text, entities, profile)).otherwise(by_labels(text, profile))


def kept_protected(text: Column, profile: str) -> Column:
    """struct<text, tokens>: what the policy keeps replaced by tokens, so that another engine leaves it alone."""
    return protected_matches(text, [p for kind, p in KEPT if action_of(profile, kind) == "keep"], KEEP_TOKEN)


def placeholders_protected(text: Column) -> Column:
    """struct<text, tokens>: placeholders that a policy left replaced by tokens."""
    return protected_matches(text, [PLACEHOLDER], PLACEHOLDER_TOKEN)
