"""Schemas, versions and policy tables. Values marked fixed must equal the published policy's for results to agree."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Versions that rows carry.
VERSIONS = {"app": "0.2.0", "resolver": "1.0", "assessment_policy": "1.0", "registry": "2026.08.08", "schema": "1"}
EXTRACTOR_VERSION = TEMPLATE_VERSION = "1.0"

SEVERITIES = ("NONE", "LOW", "MODERATE", "HIGH", "CRITICAL")
ACTIONABLE = ("CONFIRMED", "HIGH_CONFIDENCE")

# Observation type to finding category; other types give no finding.
CATEGORY_OF = {
    "EMAIL": "CONTACT_EMAIL",
    "PHONE": "CONTACT_PHONE",
    "POSTAL_ADDRESS": "HOME_ADDRESS",
    "LOCATION": "PERSONAL_LOCATION",
    "DATE_OF_BIRTH": "DATE_OF_BIRTH",
    "JOB_TITLE": "PROFESSIONAL_PROFILE",
    "EMPLOYER": "PROFESSIONAL_PROFILE",
    "ORGANISATION": "PROFESSIONAL_PROFILE",
    "SOCIAL_LINK": "SOCIAL_PROFILE",
    "USERNAME": "USERNAME",
}

# Category to sensitivity, discoverability, misuse, persistence as severity ranks; others are all LOW.
BASE_RANKS = {
    "HOME_ADDRESS": (3, 2, 3, 2),
    "CONTACT_PHONE": (2, 2, 3, 2),
    "CONTACT_EMAIL": (2, 2, 2, 2),
    "DATE_OF_BIRTH": (3, 1, 3, 3),
    "PERSONAL_LOCATION": (2, 2, 2, 1),
    "PROFESSIONAL_PROFILE": (1, 3, 1, 2),
    "SOCIAL_PROFILE": (1, 3, 1, 2),
    "USERNAME": (1, 2, 1, 2),
    "PERSONAL_DOCUMENT": (3, 1, 3, 2),
    "PUBLIC_RECORD": (2, 2, 2, 3),
    "COMPANY_RECORD": (1, 2, 1, 3),
    "IMAGE_REFERENCE": (1, 2, 1, 2),
    "OUTDATED_INFORMATION": (1, 1, 1, 1),
    "INCORRECT_INFORMATION": (1, 1, 2, 1),
    "OTHER_PERSONAL_INFORMATION": (1, 1, 1, 1),
}

# Domains and suffixes the policies name.
USER_CONTROLLED = ("linkedin.com", "github.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "medium.com", "mastodon.social")
GOV_SUFFIXES = (".gov", ".gov.uk", ".gov.au", ".mil", ".gc.ca", "europa.eu")

# Country spellings of jurisdictions.
US = ("us", "usa", "united states", "united states of america")
EU_EEA_UK = (
    "uk", "united kingdom", "gb", "gbr", "ireland", "ie", "germany", "de", "france", "fr", "spain", "es", "italy", "it",
    "netherlands", "nl", "sweden", "se", "poland", "pl", "portugal", "pt", "belgium", "be", "austria", "at", "denmark", "dk",
    "finland", "fi", "norway", "no", "iceland", "greece", "gr", "czechia", "romania", "eu", "eea",
)

# Platform domains, and path segments that route and name nobody (others use GENERIC_ROUTING).
PLATFORMS = (
    ("linkedin.com", "LinkedIn"), ("github.com", "GitHub"), ("twitter.com", "Twitter/X"), ("x.com", "Twitter/X"),
    ("facebook.com", "Facebook"), ("instagram.com", "Instagram"), ("mastodon.social", "Mastodon"), ("youtube.com", "YouTube"),
    ("tiktok.com", "TikTok"), ("medium.com", "Medium"), ("reddit.com", "Reddit"), ("t.me", "Telegram"),
)
ROUTING = {
    "LinkedIn": ("in", "pub", "company", "school", "posts", "feed"),
    "YouTube": ("channel", "user", "c", "watch", "playlist", "shorts", "feed"),
    "Reddit": ("r", "u", "user", "comments"),
    "Facebook": ("pages", "groups", "profile.php", "posts", "watch"),
    "GitHub": ("orgs", "topics", "sponsors"),
    "Medium": ("tag", "search"),
    "TikTok": ("tag", "music"),
}
GENERIC_ROUTING = ("posts", "feed")

# The case state machine.
TRANSITIONS = {
    "DISCOVERED": ("REVIEWED", "REJECTED", "NOT_APPLICABLE"),
    "REVIEWED": ("ACTION_SELECTED", "NOT_APPLICABLE", "REJECTED"),
    "ACTION_SELECTED": ("REQUEST_PREPARED", "USER_ABANDONED"),
    "REQUEST_PREPARED": ("USER_MARKED_SUBMITTED", "USER_ABANDONED"),
    "USER_MARKED_SUBMITTED": ("AWAITING_RESPONSE", "VERIFICATION_PENDING"),
    "AWAITING_RESPONSE": ("SOURCE_CHANGED", "VERIFICATION_PENDING", "REQUEST_DENIED", "SOURCE_UNREACHABLE"),
    "SOURCE_CHANGED": ("VERIFICATION_PENDING",),
    "VERIFICATION_PENDING": ("VERIFIED", "REAPPEARED", "SOURCE_UNREACHABLE", "AWAITING_RESPONSE"),
    "VERIFIED": ("REAPPEARED",),
    "REQUEST_DENIED": ("ACTION_SELECTED", "USER_ABANDONED"),
    "REAPPEARED": ("ACTION_SELECTED", "VERIFICATION_PENDING"),
    "SOURCE_UNREACHABLE": ("VERIFICATION_PENDING", "USER_ABANDONED"),
    "REJECTED": (),
    "NOT_APPLICABLE": (),
    "USER_ABANDONED": ("ACTION_SELECTED",),
}
RECHECKABLE = ("USER_MARKED_SUBMITTED", "AWAITING_RESPONSE", "VERIFICATION_PENDING", "SOURCE_CHANGED", "VERIFIED", "REAPPEARED")
GONE = ("URL_GONE", "PERSONAL_DATA_REMOVED", "CONTENT_REMOVED")

SUBJECTS = (
    "subject_id string, names array<struct<value:string,is_primary:boolean>>, locations array<struct<city:string,country:string>>, "
    "employers array<struct<name:string,domain:string,is_current:boolean>>, usernames array<string>, emails array<string>, "
    "phones array<string>, personal_domains array<string>, created_at timestamp"
)
REGISTRY = (
    "id string, provider string, route_type string, destination_kind string, jurisdictions array<string>, applies_to array<string>, "
    "official_url string, portal_url string, required_inputs array<string>, side_effects string, informational boolean, "
    "last_verified date, expires_after_days int, sources array<string>"
)
SIGNAL = "struct<kind:string,name:string,detail:string,weight:double>"


def literal_map(values: dict) -> Column:
    """A small dictionary as a map literal."""
    return F.create_map(*map(F.lit, chain(*values.items())))


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def one_of(column: Column, values) -> Column:
    return column.isin(*values)
