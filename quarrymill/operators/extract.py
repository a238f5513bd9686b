"""Facts for the dependency graph from chunks of source text, as column expressions.

This flavour also takes back-quoted paths, cuts queries and trailing slashes, and reads every
typed constructor parameter; the graph takes the union of both flavours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import matches, stripped
from quarrymill.operators.code import SCRIPTS, VERB

#: Client calls, injected fields and parameters, class layers, data-transfer
#: classes, path variables, and names of outside services.
CLIENT = rf"""(?i)\.(?:http|httpClient|_http|_httpClient)\s*\.\s*{VERB}\s*(?:<[^>]*>)?\s*\(\s*[`'"]([^`'"]+)[`'"]"""
FETCH = r"""(?i)fetch\(\s*[`'"]([^`'"]+)[`'"](?:\s*,\s*\{[^}]*?method\s*:\s*[`'"]([A-Za-z]+))?"""
AXIOS = rf"""(?i)axios\s*\.\s*{VERB}\s*\(\s*[`'"]([^`'"]+)[`'"]"""
TEMPLATE_CLIENT = r"""(?i)restTemplate\s*\.\s*(get|post|put|delete|patch|exchange)ForObject\s*\([^,\n]*['"]([^'"]+)['"]"""
WEB_CLIENT = rf"""(?i)webClient\s*\.\s*{VERB}\s*\(\s*\)\s*\.uri\s*\(\s*['"]([^'"]+)['"]"""
FIELD = r"(?:private|protected|public)\s+(?:final\s+)?([A-Z][A-Za-z0-9]+(?:Service|Repository|Repo|Client|Manager|Helper|Dao|Gateway))\s+[\p{L}\p{N}_]+"
INJECTED = r"@(?:Autowired|Inject)\s+(?:(?:private|protected|public)\s+)?(?:final\s+)?([A-Z][A-Za-z0-9]+)\s+[\p{L}\p{N}_]+\s*;"
CONSTRUCTOR = r"constructor\s*\(([^)]+)\)"
PARAMETER = r"(?:private|public|protected|readonly)\s+[\p{L}\p{N}_]+\s*:\s*([A-Z][A-Za-z0-9]+(?:Service|Client|Repository|Store|Facade|Http))"
LAYERS = {
    "controller": r"(?i)@(?:RestController|Controller)\b|Controller\s*\{",
    "service": r"(?i)@Service\b|@Injectable\b",
    "repository": r"(?i)@Repository\b|extends\s+(?:Jpa|Crud)Repository",
    "component": r"(?i)@Component\s*\(\s*\{",
}
SNIPPET = 4000
DTO = r"\b([A-Z][A-Za-z0-9]+(?:DTO|Dto|Request|Response|Payload|Model|Bean))\b"
PATH_VARIABLE = r"\{([^}]+)\}"
EXTERNAL = (
    "twilio", "sendgrid", "aws", "s3", "sns", "sqs", "kafka", "rabbitmq", "smtp", "firebase", "fcm", "gcm", "stripe", "razorpay", "sms",
)


def _cleaned(verbs: Column, paths: Column) -> Column:
    """``VERB path`` with the path cut at its query and trailing slashes; outside URLs give ''."""

    def one(verb: Column, path: Column) -> Column:
        bare = stripped(path)
        clean = F.regexp_replace(F.regexp_replace(bare, r"(?s)\?.*", ""), "/+$", "")
        return F.when((bare == "") | F.startswith(bare, F.lit("http")) | (clean == ""), "").otherwise(F.concat(F.upper(verb), F.lit(" "), clean))

    return F.zip_with(verbs, paths, one)


def http_calls(text: Column, language: Column) -> Column:
    """Distinct ``VERB path`` of outbound calls in order of the patterns."""
    pairs = lambda p: _cleaned(matches(text, p, 1), matches(text, p, 2))
    fetched = _cleaned(F.transform(matches(text, FETCH, 2), lambda v: F.when(v == "", "GET").otherwise(v)), matches(text, FETCH, 1))
    template = _cleaned(F.transform(matches(text, TEMPLATE_CLIENT, 1), lambda v: F.when(F.lower(v) == "exchange", "GET").otherwise(v)), matches(text, TEMPLATE_CLIENT, 2))
    calls = (
        F.when(language.isin(*SCRIPTS), F.concat(pairs(CLIENT), fetched, pairs(AXIOS)))
        .when(language == "java", F.concat(template, pairs(WEB_CLIENT)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.filter(calls, lambda c: c != ""))


def dependencies(text: Column, language: Column) -> Column:
    """Distinct names of injected classes, in order."""
    script = F.flatten(F.transform(matches(text, CONSTRUCTOR, 1), lambda block: matches(block, PARAMETER, 1)))
    found = (
        F.when(language == "java", F.concat(matches(text, FIELD, 1), matches(text, INJECTED, 1)))
        .when(language.isin(*SCRIPTS), script)
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(found)


def class_kind(text: Column, name: Column, language: Column) -> Column:
    """Layer of a class by the marks in its chunk's first characters, else by its name."""
    snippet, lower = F.substring(text, 1, SNIPPET), F.lower(name)
    marked = lambda kind: F.rlike(snippet, F.lit(LAYERS[kind]))
    java = F.when(marked("controller"), "controller").when(marked("service"), "service").when(marked("repository"), "repository").when(marked("component"), "component")
    for kind in ("controller", "service", "repository"):
        java = java.when(F.contains(lower, F.lit(kind)), kind)
    script = F.when(marked("component"), "component").when(marked("service"), "service")
    for kind in ("component", "service"):
        script = script.when(F.contains(lower, F.lit(kind)), kind)
    return F.coalesce(F.when(language == "java", java).when(language.isin(*SCRIPTS), script), F.lit("unknown"))


def dto_names(text: Column) -> Column:
    return F.array_distinct(matches(text, DTO, 1))


def path_params(path: Column) -> Column:
    return matches(path, PATH_VARIABLE, 1)


def is_external(name: Column) -> Column:
    lower = F.lower(name)
    return F.exists(F.array(*[F.lit(m) for m in EXTERNAL]), lambda m: F.contains(lower, m))
