"""Page columns: what the tokens of a page (functions/tokens.py) say, by array functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Very common words that say nothing about a page.
STOPWORDS = (
    "the and for you your with this that from are was were will have has not but all can our out get more new one use any may who how its their they them there here what when where which while been about into over also than then these those such only other some very just most each per via "
    "und der die das mit von den que los las por para con una del est pour les des dans sur"
).split()
#: Wording by group, as patterns that are matched without regard to case.
PHRASES = {
    "urgency": ["(account|card|kyc).{0,40}(suspend|block|expir|clos|lock|deactivat)", "within 24 hours", "immediately", "unusual activity", "confirm your identity", "update your kyc", "kyc (update|pending|expired)", "last warning", "final notice"],
    "prize": ["congratulations", "you('ve| have)? won", r"\bwinner\b", "lottery", "lucky draw", "claim (your )?(prize|reward|gift)", "free gift", "spin (the|to) win", "scratch card"],
    "job": ["work from home", "part[- ]?time", "daily (income|earning|salary|payout)", r"earn (up to )?(₹|rs\.?|inr|\$)", "per day", "simple tasks?", "like and earn", "review and earn", "telegram", "investment plan", "guaranteed returns?"],
    "tech_support": ["virus", "infected", "malware detected", "trojan", "call (microsoft|apple|windows|technical) support", "toll[- ]?free", "your (computer|pc|device) (is|has been) (locked|blocked|infected)", "do not (restart|shut ?down|close)", "error code"],
    "government": ["e-?challan", "traffic (violation|fine|challan)", "tax refund", "customs (duty|clearance|fee)", "parcel.{0,20}(on hold|held|pending)", "delivery (failed|attempt)", "update your (address|delivery)", "pending challan", "aadhaar.{0,20}(update|link|suspend)", "pan.{0,20}(update|link|block)"],
    "shopping": ["add to cart", "checkout", "buy now", r"\d{2}% off", "limited stock", "flash sale", "cash on delivery", "free shipping", "order now"],
    "crypto": ["connect (your )?wallet", "airdrop", "seed phrase", "recovery phrase", "wallet (validation|sync|verif|rectif)", "claim (tokens|airdrop|rewards)", "usdt", "bitcoin", "ethereum", r"\bnft\b"],
    "download": ["download (now|the app|update|apk)", "install (the )?(update|app|plugin)", "flash player", "missing (codec|plugin)", "update your browser", r"\.apk\b"],
}
#: What a form field asks for.
ASKS = {
    "password": r"pass(word|wd|code)?\b|pwd|\bpin\b", "card": "card.?(no|num)|cc.?(num|no)|credit.?card|debit.?card|card.?holder", "cvv": r"\bcvv2?\b|\bcvc\b|\bcsc\b|security.?code",
    "expiry": r"expir|valid.?(thru|till|upto)|\bmm.?/?.?yy\b", "otp": r"\botp\b|one.?time.?(pass|code)|verification.?code|sms.?code", "upi_pin": r"upi.?pin|\bmpin\b", "atm_pin": "atm.?pin|card.?pin",
    "aadhaar": r"aadh?aa?r|\buidai\b", "pan": r"\bpan\b.?(card|no|number)?|permanent.?account", "bank_account": r"account.?(no|num)|a/c.?no|\bifsc\b", "netbanking": r"net.?banking|internet.?banking|customer.?id|\bcif\b",
    "seed_phrase": "seed|mnemonic|recovery.?phrase|secret.?phrase|private.?key|12.?words|24.?words", "ssn": r"\bssn\b|social.?security",
}


def first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def tags(tokens: Column, most: int | None = None) -> Column:
    """Names of all opening tags in order, or of the first `most`."""
    return first(F.transform(F.filter(tokens, lambda t: t["open"]), lambda t: t["name"]), most)


def visible_text(tokens: Column) -> Column:
    """The texts of a page one after the other, without those that are not shown; runs of blanks are one blank."""
    shown = F.filter(tokens, lambda t: t["seen"] & t["text"].isNotNull() & (t["name"].isNull() | (t["name"] == "textarea")))
    return F.trim(F.regexp_replace(F.array_join(F.transform(shown, lambda t: t["text"]), " "), r"[ \t\r\n]+", " "))


def words(text: Column, most: int | None = None) -> Column:
    """Lower-case words of 3 to 30 letters, combining marks kept; all of them or the first `most`."""
    return first(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: F.length(w).between(3, 30)), most)


def title(tokens: Column) -> Column:
    """The first title, 200 characters at most; empty if there is none."""
    titles = F.filter(tokens, lambda t: t["open"] & (t["name"] == "title"))
    return F.coalesce(F.trim(F.substring(F.get(titles, F.lit(0))["text"], 1, 200)), F.lit(""))


def elements(tokens: Column, *names: str) -> Column:
    """The attributes of each element of these names, in order."""
    return F.transform(F.filter(tokens, lambda t: t["open"] & t["name"].isin(*names)), lambda t: t["attrs"])


def attribute(tag: Column, name: str) -> Column:
    """Its value, empty if there is none."""
    return F.coalesce(F.try_element_at(tag, F.lit(name)), F.lit(""))


def phrase_hits(text: Column, group: str) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("|".join(PHRASES[group])), 0)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 5)
