"""Constant maps from types to how they are shown, as Column builders. All values are fixed: they are the names that cases carry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CONTACTS = ["public_telegram_alias", "public_telegram_contact", "public_whatsapp_link", "public_phone_number", "public_email_address"]
NODE_KINDS = {"claimed_brand_identity": "claimed_brand", "public_outgoing_link": "external_destination", "public_redirect_target": "redirect_target", **dict.fromkeys(CONTACTS, "public_contact")}
RELATIONS = {"claimed_brand": "claims_brand", "external_destination": "publicly_links_to", "redirect_target": "publicly_redirects_to", "public_contact": "publishes_public_contact"}
CLAIM_CATEGORIES = {
    "public_payment_method": "payment_indicators", "public_payment_provider": "payment_indicators", "public_offer_claim": "offer_claims", "public_legal_or_license_claim": "legal_claims",
    "public_referral_code": "referral_markers", "public_tracking_identifier": "tracking_markers", "public_download_destination": "download_references",
}
EVENTS = {
    "run.started": "Investigation started", "collection.started": "Bounded crawl started", "artifact.captured": "Page evidence saved", "agent.objective.created": "Agent objective issued",
    "agent.fallback.activated": "Safe fallback activated", "tool.requested": "Agent action selected", "tool.completed": "Safe action completed", "search.lead.discovered": "Candidate lead observed",
    "candidate_page.approval_required": "Collection approval required", "candidate_page.approved": "Candidate collection approved", "candidate_page.collected": "Candidate page collected",
    "assertion.proposed": "Review assertion proposed", "review.required": "Human review required", "run.completed": "Investigation completed",
}


def mapped(column: Column, table: dict[str, str], other: str | None) -> Column:
    """``table`` as a conditional expression."""
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out if other is None else out.otherwise(other)


def node_kind(observation_type: Column) -> Column:
    return mapped(observation_type, NODE_KINDS, "public_claim")


def relation(observation_type: Column) -> Column:
    return mapped(node_kind(observation_type), RELATIONS, "displays_public_claim")


def claim_category(observation_type: Column) -> Column:
    return mapped(observation_type, CLAIM_CATEGORIES, "public_claims")


def presentation(kind: Column, observation_type: Column, category: Column) -> Column:
    """struct<visual_kind,label> of a graph node."""

    def shown(visual: str, label: str | Column) -> Column:
        return F.struct(F.lit(visual).alias("visual_kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"))

    holds = lambda column, part: F.coalesce(F.lower(column).contains(part), F.lit(False))
    contact = F.when(holds(observation_type, "whatsapp"), "WhatsApp").when(holds(observation_type, "telegram"), "Telegram").when(holds(observation_type, "email"), "Email").when(holds(observation_type, "phone"), "Phone").otherwise("Contact")
    return (
        F.when(kind.isin("case", "domain", "seed_page"), shown("page", "Investigated site"))
        .when(kind.isin("page", "collected_page"), shown("page", "Captured page"))
        .when(kind == "public_contact", shown("contact", contact))
        .when(kind == "claimed_brand", shown("brand", "Claimed brand"))
        .when((kind == "public_claim") & (holds(category, "payment") | holds(category, "transaction")), shown("transaction", "Transaction"))
        .when((kind == "public_claim") & holds(category, "offer"), shown("offer", "Offer"))
        .when(kind == "redirect_target", shown("destination", "Redirect"))
        .when(kind == "external_destination", shown("destination", "Destination"))
        .when(kind.isin("candidate", "candidate_domain"), shown("candidate", "Candidate"))
        .otherwise(shown("other", "Other evidence"))
    )


def event_label(kind: Column, interaction: Column) -> Column:
    """What a timeline calls an event; null for kinds that it does not show."""
    return F.when((kind == "artifact.captured") & F.coalesce(interaction, F.lit(False)), "Interaction evidence saved").otherwise(mapped(kind, EVENTS, None))
