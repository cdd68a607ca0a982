"""Names, parties and places: what a value looks like, how it is cleaned, and whether a candidate is accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import collapse_spaced_letters, digits, fix_missing_spaces, match_text, normalize_whitespace, odd_spacing_ratio, remove_diacritics
from quarry.functions.values import format_money, parse_date, parse_money
from quarry.operators.extract import matches

#: Regexes over accent-free lower case, by what they find.
NOISE = r"\b(aposentadoria|auxilio|beneficio|procedimento|classe|assunto|processo|requerente|interessad[oa]|promovent[eo]|promovid[oa]|reu|autor|juiz|juiza|juizo|vara|comarca|tribunal|diretoria|diretor|diretora|documento|pagina|fls|assinado|eletronicamente|honorari\w*|pagamento|requer\w*|reserva|orcament\w*|conta|bancari\w*|natureza|servic\w*|relatoria|desembargador|sessao|excelencia|consideracao|submet\w*)\b"
BOILERPLATE = r"\bdocumento\s*\d+\b|\bpagina\b|\bassinad[ao]\b|\bprocesso\s*n[ºo]?\b|\b(diretoria|tribunal|forum|cartorio|juizo)\b"
SPECIALTY = r"\b(engenheir\w*|engenhar\w*|arquitet\w*|psicolog\w*|psiquiatr\w*|medic\w*|fonoaud\w*|fisioterap\w*|odont\w*|contador\w*|assistente\s+social|grafotec\w*|economist\w*|administrador\w*|biolog\w*|quimic\w*|farmac\w*|ortoped\w*|cardiolog\w*|neurolog\w*|nutricion\w*|terapeut\w*|seguranca\s+do\s+trabalho)\b"
NO_NAME = r"\b(perito|perita|interessad[oa]|cpf|cnpj|pis|pasep|inss|rg)\b|\b(engenheir|arquitet|contador|psicol|medic|odont|assistente\s+social|fonoaud|fisioterap|economist|administrador|biolog|quimic|farmac)\b"
PLACE_LEAK = r"(interessad|requerente|autor|reu|promovent|promovid|movid[oa]|em\s+face|processo|autos|vara|cartorio|tribunal|diretoria)"
#: Labels that a value may still carry in front.
LABELS = "processo requerente interessado interessada promovente promovido perito cpf comarca vara juizo juízo".split()
#: Parts of a specialty, and the kind of work they stand for; the first that occurs counts.
WORK_KINDS = [("medic", "medica"), ("grafotec", "grafotecnica"), ("contab", "contabil"), ("engenh", "engenharia"), ("psicol", "psicologica"), ("odontol", "odontologica"), ("psiquiatr", "psiquiatrica"), ("fonoaud", "fonoaudiologica"), ("fisioter", "fisioterapica"), ("informat", "informatica"), ("ambient", "ambiental"), ("arquitet", "arquitetonica")]
#: The longest candidate of a field, by its name or how that begins.
LONGEST = {"PROCESSO_ADMINISTRATIVO": 40, "PROCESSO_JUDICIAL": 40, "CPF_PERITO": 20, "ADIANTAMENTO": 30, "PERCENTUAL": 30, "PARCELA": 30, "FATOR": 30, "COMARCA": 80, "VARA": 120, "PERITO": 120, "ESPECIALIDADE": 120, "ESPECIE_DA_PERICIA": 120}
CPF = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def plain(c: Column) -> Column:
    """Accents off, lower case."""
    return F.lower(remove_diacritics(c))


def _words(c: Column) -> Column:
    return F.filter(F.split(normalize_whitespace(c), " "), lambda x: x != "")


def _yes(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def has_noise(c: Column) -> Column:
    return _yes(plain(c).rlike(NOISE))


def has_boilerplate(c: Column) -> Column:
    return _yes(plain(c).rlike(BOILERPLATE))


def is_person(c: Column) -> Column:
    """Two words of two letters or more, no digits, and neither a label nor a profession by itself."""
    return _yes(~c.rlike(r"\p{Nd}") & ~plain(normalize_whitespace(c)).rlike(NO_NAME) & (F.size(F.filter(_words(c), lambda x: F.length(x) >= 2)) >= 2))


def is_person_strict(c: Column) -> Column:
    """The same, and no word is shorter."""
    return is_person(c) & _yes(F.forall(_words(c), lambda x: F.length(x) >= 2))


def is_catalog_name(c: Column) -> Column:
    return _yes((F.length(c) >= 5) & ~F.contains(c, F.lit("@")) & ~c.rlike("(?i)interessad[oa]|sighop") & c.rlike("(?iu)[A-Za-zÁÂÃÀÉÊÍÓÔÕÚÇ]"))


def is_party(c: Column, institutional: Column | None = None) -> Column:
    """4 to 120 characters, letters and no digits, no institution, boilerplate, noise or money; two words or a company's ending."""
    v = normalize_whitespace(c)
    company = v.rlike(r"(?i)(?:S\s*[\./]?\s*A\.?$|LTDA\.?$|EIRELI$)")
    amounts = v.rlike(r"(?iu)\b(R\s*\$|valor|honor[aá]ri|percentual|resolu[cç][aã]o|guarda\s+unilateral)\b")
    shape = F.length(v).between(4, 120) & v.rlike(r"\p{L}") & ~v.rlike(r"\d") & ~v.rlike(EMAIL) & ~amounts
    return _yes(shape & ~has_noise(v) & ~has_boilerplate(v) & ((F.size(_words(v)) >= 2) | company) & F.forall(_words(v), lambda x: F.length(x) <= 28)) & (F.lit(True) if institutional is None else ~_yes(institutional))


def is_court(c: Column) -> Column:
    return _yes(plain(c).rlike("vara|juizo|juizado"))


def is_district(c: Column) -> Column:
    """A town, with or without its state, or a text that says so itself."""
    v = normalize_whitespace(c)
    shape = F.length(v).between(3, 80) & ~v.rlike(r"\p{Nd}") & ~v.rlike(EMAIL)
    town = v.rlike(r"[A-Za-zÀ-ÿ]{3,}(?:\s+[A-Za-zÀ-ÿ]{2,})*\s*/\s*[A-Z]{2}") | v.rlike(r"^[A-Za-zÀ-ÿ]{3,}(?:[ '\-][A-Za-zÀ-ÿ]{2,}){0,6}(?:\s*(?:-|/)?\s*[A-Z]{2})?$")
    return _yes(shape & (plain(v).rlike("comarca|juizo|juizado") | (~plain(v).rlike(PLACE_LEAK) & town)))


def is_specialty(c: Column) -> Column:
    return _yes(plain(c).rlike(SPECIALTY))


def is_noisy_expert(c: Column) -> Column:
    """An expert's name that still holds a label, a profession or an address; missing ones count."""
    norm = match_text(c)
    return F.coalesce(F.trim(c) == "", F.lit(True)) | _yes(F.contains(c, F.lit("@")) | norm.rlike("perito|engenheiro|medic|grafotec|grafoscop|psicol|assistente social"))


def strip_label(c: Column) -> Column:
    """Without a known label and its colon or dash in front."""
    found = F.regexp_extract(F.trim(c), rf"(?iu)^\s*(?:{'|'.join(LABELS)})\s*[:\-]\s*(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(c))


def clean_party(c: Column) -> Column:
    """A party's name without identifiers, what follows them, digits and signs."""
    v = collapse_spaced_letters(c)
    for pattern, by in ((r"(?i)\b(CPF|CNPJ)\b.*$", ""), (r"(?i)\bperante\b.*$", ""), (r"(?iu)\bju[ií]zo\b.*$", ""), (r"\d+", ""), (r"[^A-Za-zÁÂÃÀÉÊÍÓÔÕÚÇ\\s'\\\-]+", " "), (r"^[,;\-– ]+|[,;\-– ]+$", "")):
        v = F.regexp_replace(v, pattern, by)
    return normalize_whitespace(v)


def clean_person(c: Column) -> Column:
    """A person's name without the word for expert and signs, and with lost blanks put back."""
    v = F.regexp_replace(collapse_spaced_letters(c), r"(?i)\bperit[oa]\b", "")
    v = F.regexp_replace(v, r"[^A-Za-zÁÂÃÀÉÊÍÓÔÕÚÇ\s'-]+", " ")
    return normalize_whitespace(F.regexp_replace(v, r"(?<=[a-záâãàéêíóôõúç])(?=[A-ZÁÂÃÀÉÊÍÓÔÕÚÇ])", " "))


def work_kind(c: Column) -> Column:
    """The kind of work that a specialty stands for; empty if none does."""
    out, norm = F.lit(""), match_text(F.coalesce(c, F.lit("")))
    for part, kind in reversed(WORK_KINDS):
        out = F.when(F.contains(norm, F.lit(part)), kind).otherwise(out)
    return out


def _clean_party_text(c: Column) -> Column:
    v = normalize_whitespace(c)
    for pattern, by in ((r"(?i)\bCPF\s*[:\-]?\s*\d{3}\.\d{3}\.\d{3}-\d{2}\b", ""), (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", ""), (r"(?iu)\s+perante\s+o\s+ju[ií]zo.+$", ""), (r"\s+", " "), (r"\s*,\s+e\s+", " e "), (r"\s*,\s*$", ""), (r"^[ ,;\-]+|[ ,;\-]+$", "")):
        v = F.regexp_replace(v, pattern, by)
    return v


#: Cleaners and validators that rule files name.
CLEANERS = {
    "CLEANMONEY": lambda c: F.coalesce(format_money(parse_money(c)), c),
    "CLEANPARTE": _clean_party_text,
    "CLEANPERITO": normalize_whitespace,
    "CLEANPROFISSAO": normalize_whitespace,
    "CLEANPROFISSÃO": normalize_whitespace,
    "CLEANCOMARCA": normalize_whitespace,
}
VALIDATORS = {
    "VALIDATEMONEY": lambda c: c.rlike(r"\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2}"),
    "VALIDATEPARTE": lambda c: c.rlike("[A-Za-zÁÂÃÀÉÊÍÓÔÕÚÇ]"),
    "VALIDATEPERITO": lambda c: F.length(c) >= 5,
    "VALIDATECOMARCA": lambda c: F.length(c) >= 3,
}


def cleaned(c: Column, keys: list[str]) -> Column:
    """A value behind the named cleaners, in their order; unknown names change nothing."""
    for key in keys:
        c = CLEANERS.get(key.strip().upper(), lambda x: x)(c)
    return c


def valid(c: Column, keys: list[str]) -> Column:
    """Whether all named validators accept a value; unknown names do."""
    out = F.lit(True)
    for key in keys:
        out = out & VALIDATORS.get(key.strip().upper(), lambda x: F.lit(True))(c)
    return _yes(out)


def field_value(field: Column, c: Column, case_number: str = r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}") -> Column:
    """An extracted value in its field's form: CPF digits, R$ amounts, ISO dates, case numbers; else repaired text."""
    v = normalize_whitespace(c)
    v = F.when(odd_spacing_ratio(v) >= 0.12, collapse_spaced_letters(v)).otherwise(v)
    v = fix_missing_spaces(v)
    number = F.regexp_extract(F.regexp_replace(v, r"\s+", ""), case_number, 0)
    return (
        F.when(field == "CPF_PERITO", digits(v))
        .when(field.startswith("VALOR_") | (field == "ADIANTAMENTO"), F.coalesce(format_money(parse_money(v)), F.lit("")))
        .when((field == "DATA") & parse_date(v).isNotNull(), parse_date(v).cast("string"))
        .when(field.startswith("PROCESSO_") & (number != ""), number)
        .otherwise(v)
    )


def candidate_form(field: Column, c: Column) -> Column:
    """The form in which two candidates of a field are the same: digits, amounts, percentages, dates, else accent-free lower case."""
    raw = normalize_whitespace(c)
    percent = F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), r"\.", ",")
    return F.coalesce(
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(""))
        .when(field.isin("PROCESSO_ADMINISTRATIVO", "PROCESSO_JUDICIAL", "CPF_PERITO"), digits(raw))
        .when(field.startswith("VALOR_") | field.isin("ADIANTAMENTO", "PARCELA"), F.coalesce(format_money(parse_money(raw)), F.lower(raw)))
        .when(field.isin("PERCENTUAL", "FATOR"), F.when(percent.endswith("%"), percent).otherwise(F.concat(percent, F.lit("%"))))
        .when(field.startswith("DATA_"), F.coalesce(parse_date(raw).cast("string"), plain(raw)))
        .otherwise(plain(raw)),
        F.lit(""),
    )


def cpf_in_context(cpf: Column, context: Column) -> Column:
    """False if a text shows the number beside a party's words and not an expert's, within 120 characters; else true."""
    number = digits(F.coalesce(cpf, F.lit("")))
    text = F.coalesce(context, F.lit(""))

    def bad(m: Column) -> Column:
        begin = F.greatest(F.lit(0), m["start"] - 120)
        window = normalize_whitespace(plain(F.substring(text, begin + 1, m["end"] + 120 - begin)))
        same = digits(m["text"]) == number
        expert = window.rlike(r"\b(perit|interessad|parte\s*:|assistente\s+social)\b")
        party = F.contains(window, F.lit("cpf/cnpj")) | window.rlike(r"\b(autor|reu|movid[oa]\s+por|em\s+face|promovent|promovid)\b")
        return same & party & ~expert

    return (number == "") | ~F.exists(matches(text, r"\b\d{3}\s*\.?\s*\d{3}\s*\.?\s*\d{3}\s*-?\s*\d{2}\b", "CPF"), bad)


def accepted(field: Column, c: Column) -> Column:
    """Whether a candidate may be its field's value: not too long, and of the shape that names, parties and places have."""
    v = normalize_whitespace(c)
    longest = F.lit(0)
    for name, most in LONGEST.items():
        longest = F.when(field == name, most).otherwise(longest)
    longest = F.when(field.startswith("VALOR_"), 30).when(field.startswith("DATA_"), 40).otherwise(longest)
    words, bare = _words(v), remove_diacritics(v)
    capitals = F.size(F.filter(words, lambda x: (F.length(x) > 1) & x.rlike(r"^\p{Lu}")))
    expert = is_person(v) & ~has_noise(v) & (capitals >= 2) & ~bare.rlike(r"(?i)\b(para|caso|autos|processo|epigrafe|judicial|movido|promovente|promovido|requerente|interessad[oa]|vara|comarca)\b")
    lettered = F.size(F.filter(words, lambda x: x.rlike("[A-Za-zÀ-ÿ]{2,}")))
    shouted = F.size(F.filter(words, lambda x: x.rlike("^[A-ZÀ-Ÿ]{2,}$")))
    party = ~has_noise(v) & ~bare.rlike(r"(?i)\b(caso|processo|autos|juizo|vara|comarca|face|epigrafe)\b") & (F.size(words) >= 2) & (lettered >= 2) & ((capitals >= 1) | (shouted >= 2))
    named = field.isin("PERITO", "PROMOVENTE", "PROMOVIDO", "ESPECIALIDADE", "ESPECIE_DA_PERICIA", "COMARCA", "VARA")
    shape = F.when(field == "PERITO", expert).when(field.isin("PROMOVENTE", "PROMOVIDO"), party).otherwise(F.lit(True))
    return _yes((v != "") & ((longest == 0) | (F.length(v) <= longest)) & ~(named & has_boilerplate(v)) & shape)


def suspect(field: Column, c: Column) -> Column:
    """Whether a report should point at a value: an identifier of the wrong length, or a name that is none."""
    n = F.length(digits(F.coalesce(c, F.lit(""))))
    odd = F.when(field == "CPF_PERITO", n != 11).when(field == "PROCESSO_JUDICIAL", n != 20).when(field == "PERITO", ~is_person(c)).when(field.isin("PROMOVENTE", "PROMOVIDO"), ~is_party(c)).when(field.startswith("VALOR_"), parse_money(c).isNull()).when(field.startswith("DATA_"), parse_date(c).isNull())
    return _yes((F.trim(c) != "") & odd)
