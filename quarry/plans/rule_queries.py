"""Queries over single functions, each against expected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions import values as v
from quarry.operators import assemble, documents, enrich, extract, names, rules
from quarry.plans.cases import cases


def flags(*tests):
    """Which of several tests hold, as their numbers."""
    return lambda c: F.concat_ws("", *(F.when(F.coalesce(test(c), F.lit(False)), str(n)) for n, test in enumerate(tests)))


def shown(c: Column) -> Column:
    """A struct or array as JSON."""
    return F.to_json(c)


cases("missing_spaces", t.fix_missing_spaces, [("a,b(c)d 12x aB", "a, b (c)) d 12 x a B"), ("Vara:3;x", "Vara: 3; x"), (" a  b ", "a b"), ("Art.5º", "Art.5º"), (None, None)])
cases("spaced_letters", t.collapse_spaced_letters, [("d i r e t o r i a foi", "diretoria foi"), ("D I R E da CO MA RCA", "DIRE da COMARCA"), ("a\nb c", "a bc"), ("um a b", "um ab"), ("DE A", "DE A")])
cases("split_capitals", t.fix_uppercase_split_tokens, [("o DI RE TOR DE AB", "o DIRETOR DE AB"), ("VA NOS RA", "VA NOS RA"), ("AB C", "AB C"), ("AB CD", "ABCD"), ("PELO AB CD", "PELO ABCD")])
cases("glued_capitals", t.fix_uppercase_glue, [("VARADACOMARCA", "VARA DA COMARCA"), ("Varadacomarca", "Varadacomarca"), ("SALA2B", "SALA 2 B"), ("UM DA UM DA UM", "UM DA UM DA UM")])
cases("broken_words", t.fix_broken_words, [("trib un al foi", "tribunal foi"), ("casa de campo", "casa de campo"), ("pala vrA", "pala vrA"), ("pala vRa foi", "palav Rafoi"), ("COMA RCA", "COMARCA"), ("12 ab", "12 ab")])
cases("capital_runs", t.fix_uppercase_token_runs, [("A B C x AB CD", "ABC x AB CD"), ("AB CD EF GH i", "ABCDEFGH i"), ("AB CD", "AB CD"), ("x A BC DEF", "x ABCDEF")])
cases("word_splits", t.fix_uppercase_word_splits, [("COMA RCA DE ABCDE", "COMARCA DE ABCDE"), ("ABC DE", "ABC DE"), ("ABC DEF GHI", "ABCDEF GHI"), ("ab CDE", "ab CDE")])
cases("prefix_splits", t.fix_uppercase_prefix_splits, [("CO MARCA DE LIMA", "COMARCA DE LIMA"), ("DE LIMA", "DE LIMA"), ("AB CDEF GHIJ", "ABCDEF GHIJ")])
cases("line_break_splits", t.fix_line_break_splits, [("magis-\n tratura e-mail", "magistratura e-mail"), ("TRIBU\nNAL x", "TRIBUNAL x"), ("uma\nlinha", "uma linha"), ("COMARCA\nDE LIMA", "COMARCA DE LIMA")])
cases("title_glue", t.fix_title_glue, [("umaCasa abC", "uma Casa abC"), ("abCasa", "abCasa"), ("JoãoSilva", "João Silva")])
cases("pattern_texts", t.normalize_pattern_text, [(" d i r e t o r  foi,aqui ", "diretor foi, aqui"), ("TRI BUN AL", "TRIBUNAL"), ("Vara:3", "Vara: 3")])
cases("full_texts", t.normalize_full_text, [("VARADACOMARCA", "VARA DA COMARCA"), ("a casaGrande", "a casa Grande"), ("", "")])
cases("match_texts", t.match_text, [("Órgão: 5/A", "orgao 5/a"), ("d i r e t o r", "diretor"), ("a,b", "a b")])
cases("doubled_letters", t.collapse_doubled, [("AABBCC", "ABC"), ("AABBC", "AABBC"), ("abcdef", "abcdef"), ("AABBCx", "AABBCx"), ("AABB", "AABB")])
cases("case_numbers_of_files", t.process_number, [("/x/12 ab-3.pdf", "123"), ("/x/ab.pdf", None), ("0801234.pdf", "0801234")])
cases("split_words", lambda c: t.fix_split_words(c, ["de", "e"]), [("carr o de casa", "carro de casa"), ("um a", "uma"), ("x 1 a", "x 1 a")])
cases("template_values", lambda c: F.regexp_extract(c, t.template_regex("fee of {{value}} due", r"(\d+)"), 1), [("a fee  of 12 due", "12"), ("fee of x due", ""), ("fee\nof 7 due", "7")])
cases("words_once", lambda c: F.array_join(F.transform(t.dedupe_words(F.from_json(c, "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")), lambda w: w["text"]), " "), [
    ('[{"text":"A","x0":1,"y0":1,"x1":2,"y1":2},{"text":"a","x0":1.0001,"y0":1,"x1":2,"y1":2},{"text":"b","x0":1,"y0":1,"x1":2,"y1":2}]', "A b"),
    ('[{"text":"A","x0":1,"y0":1,"x1":2,"y1":2},{"text":"A","x0":1.01,"y0":1,"x1":2,"y1":2}]', "A A"),
])
cases("money_values", v.parse_money, [("45 0, 00", "450.00"), ("R$ 1.234,5", "1234.50"), ("1.234", "1234.00"), ("45-0,00", "450.00"), ("R$ 1.234,56 - total", "123456.00"), ("-5,00", "-5.00"), ("x", None), ("12.34", "12.34")])
cases("date_values", v.parse_date, [("14/2/26", "2026-02-14"), ("14-02-26", "2026-02-14"), ("14-2-26", "2026-02-14"), ("2026/02/14", None), ("14.02.2026", None), ("31/02/2024", None), ("5 de marco de 2024", "2024-03-05"), ("5 de março de 2024", None), ("2024-02-07", "2024-02-07"), ("7/2/2024", "2024-02-07"), ("7/2-2024", None), ("01/01/99", "1999-01-01")])
cases("typed_patterns", t.typed_pattern, [("529.982.247-25 52998224725: R$ nº n° : de 14/2/26 1ª 2º 5 a", "F2F2:VR2R2SP2A2N2aN2oN1P1"), ("João 12 AB a@b.co x1 1.234,50 --", "T2N2U2EM2V2S"), ("12345678000195 0801234-56.2024.8.15.2001 x,5 McX É ç", "J2Q2V2M2U1L1")])
cases("block_patterns", t.block_pattern, [("a : b: cd", "1:WW"), ("", ""), ("ab c", "W1")])
cases("entity_cases", lambda c: F.array_join(F.transform(extract.entities(c), lambda e: F.concat_ws("@", e["label"], e["start"].cast("string"), e["text"])), "|"), [
    ("cpf 52998224725 em 5 de abril de 2024", "CPF@4@52998224725|DATA@19@5 de abril de 2024"),
    ("pagou 1234,50 e R$ 1.234,50", "VALOR@6@1234,50|VALOR@16@R$ 1.234,50"),
    ("0801234-56.2024.8.15.2001 e 0801234-56.2024.8.15", "CNJ@0@0801234-56.2024.8.15.2001|CNJ_PARTIAL@28@0801234-56.2024.8.15"),
    ("12.345.678/0001-95 a@b.com.br 1/2/2024", "CNPJ@0@12.345.678/0001-95|EMAIL@19@a@b.com.br|DATA@30@1/2/2024"),
    ("nada", ""),
])
cases("instalments", enrich.parse_instalments, [("em 3 parcelas", "3"), ("sem", None), ("12345", "123")])
cases("factors", enrich.looks_like_factor, [("1,5", "true"), ("R$ 1,50", "false"), ("25", "false"), ("x", "false"), ("20", "true")])
cases("match_penalties", lambda c: F.round(enrich.match_score(F.lit(0.9), F.lit(0.1), c), 2), [("raw", "0.8"), ("percent_total", "0.75"), ("per_unit", "0.72"), ("percent_total_per_unit", "0.68"), ("multiple_7", "0.62"), ("other", "0.7")])
cases("unit_value_ways", lambda c: F.array_join(F.transform(F.filter(enrich.unit_values(F.lit(100).cast("decimal(18,2)"), F.get(F.split(c, "/"), 0).try_cast("double"), F.get(F.split(c, "/"), 1).try_cast("int")), lambda u: ~u["way"].isin(*(f"multiple_{n}" for n in range(3, 21)))), lambda u: F.concat_ws("=", u["way"], F.round(u["value"], 2).cast("string"))), "|"), [
    ("-/-", "raw=100.00|multiple_2=50.00"),
    ("30/-", "raw=100.00|percent_total=333.33"),
    ("30/2", "raw=100.00|percent_total=333.33|percent_total_per_unit=166.67|per_unit=50.00"),
    ("-/4", "raw=100.00|per_unit=25.00"),
    ("150/-", "raw=100.00"),
])
cases("labels_off", names.strip_label, [("Perito: Ana Exemplo", "Ana Exemplo"), ("juízo - da capital", "da capital"), ("Ana: x", "Ana: x"), (" VARA:  3 ", "3")])
cases("party_names", names.clean_party, [("Ana Exemplo CPF 1", "Ana Exemplo CPF"), ("Ana Exemplo CPF 529.982", "Ana Exemplo"), ("Banco 21 perante o juízo", "Banco"), ("João da Silva,", "Jo o da Silva")])
cases("person_names", names.clean_person, [("Perita Ana  Exemplo 12", "Ana Exemplo"), ("anaExemplo", "ana Exemplo"), ("J. O'Neil", "J O'Neil")])
cases("work_kinds", names.work_kind, [("Engenharia civil", "engenharia"), ("médico psiquiatra", "medica"), ("poeta", ""), (None, ""), ("Psiquiatria", "psiquiatrica")])
cases("strategy_cleaners", lambda c: names.cleaned(c, ["CLEANPARTE"]), [("1.234,5", "1.234,5"), ("Ana CPF: 111.222.333-44", "Ana"), ("Ana , e Bia,", "Ana e Bia"), ("Ana perante o juízo da vara", "Ana")])
cases("money_cleaner", lambda c: names.cleaned(c, ["cleanmoney"]), [("1.234,5", "R$ 1.234,50"), ("x", "x")])
cases("strategy_validators", flags(lambda c: names.valid(c, ["VALIDATEMONEY"]), lambda c: names.valid(c, ["validateperito"]), lambda c: names.valid(c, ["VALIDATECOMARCA", "VALIDATEPARTE"]), lambda c: names.valid(c, ["OTHER"])), [("R$ 1.234,50", "0123"), ("Lima", "23"), ("12", "3")])
cases("field_values", lambda c: names.field_value(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), [
    ("CPF_PERITO|529.982.247-25", "52998224725"), ("VALOR_ARBITRADO_JZ|1234,5", "R$ 1.234,50"), ("VALOR_ARBITRADO_JZ|nada", ""), ("DATA|5 de abril de 2024", "2024-04-05"),
    ("PROCESSO_JUDICIAL|0801234-56 .2024.8.15.2001 x", "0801234-56.2024.8.15.2001"), ("VARA|3a  Vara", "3 a Vara"), ("ADIANTAMENTO|12", "R$ 12,00"),
])
cases("candidate_forms", lambda c: names.candidate_form(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), [
    ("PROCESSO_JUDICIAL|0801-2", "08012"), ("VALOR_ARBITRADO_DE|R$ 10", "R$ 10,00"), ("PARCELA|Única", "única"), ("PERCENTUAL|30.5", "30,5%"), ("FATOR|2 %", "2%"),
    ("DATA_REQUISICAO|7/2/2024", "2024-02-07"), ("DATA_REQUISICAO|Amanhã", "amanha"), ("PERITO| Ana  ÉLIDA", "ana elida"), ("PERITO|", ""),
])
cases("name_shapes", flags(names.is_person, names.is_person_strict, names.is_catalog_name, names.is_party, names.is_court, names.is_district, names.is_specialty, names.has_noise, names.has_boilerplate, names.is_noisy_expert), [
    ("Ana Exemplo", "01235"), ("Ana E Exemplo", "023"), ("Perita Ana", "235"), ("Vara da Comarca", "012457"), ("Fulano LTDA", "01235"), ("X", ""),
    ("Engenheiro civil", "012356" + "9"), ("documento 12", "278"), ("João Pessoa / PB", "0235"), (None, "9"),
])
cases("accepted_candidates", lambda c: names.accepted(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), [
    ("PERITO|Ana Exemplo Teste", "true"), ("PERITO|ana exemplo", "false"), ("PERITO|Ana Processo", "false"), ("PROMOVENTE|BANCO EXEMPLO", "true"), ("PROMOVENTE|Banco", "false"),
    ("VARA|3a Vara, documento 12", "false"), ("PROCESSO_JUDICIAL|" + "1" * 41, "false"), ("PROCESSO_JUDICIAL|" + "1" * 40, "true"), ("VALOR_ARBITRADO_JZ|", "false"),
])
cases("cpf_contexts", lambda c: names.cpf_in_context(F.lit("529.982.247-25"), c), [("perito Ana, CPF 529.982.247-25", "true"), ("promovido Bia CPF 529.982.247-25", "true"), ("autor: Bia CPF 529.982.247-25", "false"), ("autor: Bia 111.222.333-44", "true"), ("em face de Bia, 529.982.247-25; parte: Ana", "false"), ("em face de Bia, 529.982.247-25, assistente social", "true"), (None, "true")])
cases("suspects", lambda c: names.suspect(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), [("CPF_PERITO|123", "true"), ("CPF_PERITO|52998224725", "false"), ("PERITO|Ana", "true"), ("DATA_REQUISICAO|hoje", "true"), ("VALOR_ARBITRADO_DE|1,00", "false"), ("VARA|x", "false"), ("PERITO|", "false")])

ORDER = documents.Kind("order", aliases=["despacho", "order note"], require=["order", "pay"], any=["judge", "court"], strong_pairs=[["fees", "granted"]], blocked_any=["draft"], title_keywords=["order"])
CERTIFICATE = documents.Kind("certificate", aliases=["certidao"], require=["certify"], strong_any=["council session"], title_keywords=["certificate"], blocked_all=["void", "copy"])
REQUEST = documents.Kind("request", aliases=["requerimento"], require=["request"], title_keywords=["request", "order"])
KINDS = [ORDER, CERTIFICATE, REQUEST]
_text = documents.document_text

cases("guards", lambda c: documents.guard(_text(c), ORDER.require, ORDER.any), [("Order to  PAY, the Judge", "true"), ("order to pay", "false"), ("the judge", "false"), (None, "false")])
cases("strong_signals", lambda c: documents.strong(_text(c), CERTIFICATE.strong_any, ORDER.strong_pairs), [("in councilsession", "true"), ("fees are granted", "true"), ("fees", "false"), ("", "false")])
cases("kinds_of_text", flags(*(lambda c, k=k: documents.is_kind(_text(c), k) for k in KINDS)), [("order to pay by court", "0"), ("draft order to pay by court", ""), ("we certify a request", "12"), ("we certify this void copy", ""), ("fees granted", "0")])
cases("kinds_of_parts", lambda c: documents.is_kind_of_parts(_text(F.substring_index(c, "|", 1)), _text(F.substring_index(c, "|", -1)), ORDER), [("order|pay the court", "true"), ("x|order to pay the court", "true"), ("order|x", "false")])
cases("signature_pages", lambda c: documents.is_signature_page(_text(c), ["signed", "code", "link", "date"], ["order to pay"]), [("signed code link", "true"), ("signed code", "false"), ("signed code link order to pay", "false"), ("", "true")])
cases("rejected_texts", flags(lambda c: documents.is_rejected(c, ["not valid", "Cópia"]), lambda c: documents.is_rejected(c, ["a-b"], loose=True)), [("this is NOTVALID", "0"), ("uma cópia", "0"), ("a-b", "1"), ("fine", ""), (None, "")])
cases("kind_keys", lambda c: documents.kind_key(c, KINDS), [("/rules/tjpb_DESPACHO.yml", "order"), ("Certidão", "certificate"), ("order-note", "order"), ("my requests", None), ("request", "request")])
cases("kind_keywords", lambda c: F.element_at(F.create_map(*(F.lit(x) for k, which in (("title", "title"), ("guard", "guard")) for x in (k, ",".join(documents.keywords(KINDS, which))))), c), [("title", "order,certificate,request"), ("guard", "order,pay,judge,court,certify,request")])
cases("page_evidence_kinds", lambda c: shown(documents.page_evidence(
    [("title", [_text(F.substring_index(c, "|", 1))]), ("body", [_text(F.substring_index(c, "|", -1))])],
    [("certificate", lambda x: documents.is_kind(x, CERTIFICATE), False), ("order", lambda x: documents.is_kind(x, ORDER), True), ("request", lambda x: documents.is_kind(x, REQUEST), False)],
    F.contains(_text(c), F.lit("blocked")),
)), [
    ("certify|order to pay court", '{"kind":"certificate","method":"title"}'), ("x|order to pay court", '{"kind":"order","method":"body"}'), ("order to pay court|blocked request", '{"kind":"request","method":"body"}'), ("x|y", '{"kind":"UNKNOWN","method":""}'),
])
cases("cross_checks", lambda c: shown(documents.cross_check(F.lit("order"), {k.key: documents.is_kind(_text(c), k) for k in KINDS})), [("order to pay court", '{"own":true,"other":false}'), ("we certify", '{"own":false,"other":true}'), ("x", '{"own":false,"other":false}')])
cases("accepted_winners", lambda c: documents.accept_other(F.contains(c, F.lit("g")), F.contains(c, F.lit("s")), F.contains(c, F.lit("t")), F.length(c)), [("g", "true"), ("st1234", "true"), ("st", "false"), ("s12345", "false")])
cases("candidate_scores", lambda c: documents.candidate_score([(documents.is_kind(_text(c), ORDER), 5), (F.contains(_text(c), F.lit("court")), 1), (F.contains(_text(c), F.lit("draft")), -5)]), [("order to pay court", "6"), ("court", "1"), ("draft", "0")])

cases("sequences", lambda c: shown(rules.sequential_fields(c, [("n", r"no (\d+)", 1), ("who", r"by (\w+)", 1), ("again", r"no (\d+)", 1)])), [
    ("no 1 by ana no 2", '[{"field":"n","value":"1","start":0},{"field":"who","value":"ana","start":5},{"field":"again","value":"2","start":12}]'),
    ("by ana no 7", '[{"field":"n","value":"7","start":7},{"field":"who"},{"field":"again"}]'),
])
cases("slices", lambda c: rules.slice_between(c, "start", "end"), [("a start b end c end", "start b end"), ("end start", None), ("x", None)])
cases("signatures", lambda c: shown(rules.signature(c)), [
    ("Assinado eletronicamente por Ana Exemplo em 07/02/2024", '{"signer":"Ana Exemplo","signed_on":"2024-02-07","complete":true}'), ("documento assinado por: Bia Lima, juíza", '{"signer":"Bia Lima","complete":false}'), ("nada", '{"complete":false}'),
])
cases("signer_names", lambda c: rules.same_signer(c, F.array(F.lit("Ana Élida Lima"), F.lit("Bia"))), [("anaelidalima", "Ana Élida Lima"), ("BIA", "Bia"), ("Caio", None)])
cases("expert_texts", lambda c: shown(enrich.parse_expert(c)), [("Perito: Ana Exemplo - CPF 529.982.247-25", '{"name":"Ana Exemplo","cpf":"52998224725"}'), ("Ana Exemplo, Maria Exemplo Teste", '{"name":"Maria Exemplo Teste"}'), ("perita", "{}")])
cases("place_ranges", lambda c: shown(assemble.place_range(F.from_json(c, "array<int>"), F.lit(1), F.lit(4))), [("[9,0,3,4,5]", '{"first":3,"last":4}'), ("[1,0,0,0]", "{}"), ("[1,2]", '{"first":2,"last":2}')])
cases("operator_ranges", lambda c: F.concat_ws(" ", shown(assemble.parse_range(c)), assemble.format_range(assemble.parse_range(c)["first"], assemble.parse_range(c)["last"], assemble.parse_range(c)["operator"])), [("op12-40[Tj]", '{"first":12,"last":40,"operator":"Tj"} op12-40[Tj]'), ("op7", '{"first":7,"last":7} op7'), ("x", "")])
cases("module_states", lambda c: shown(assemble.module_status(F.contains(c, F.lit("a")), F.regexp_extract(c, "e:(.*)", 1), F.length(c) - 1)), [("a", '{"status":"ok","reason":"no_change"}'), ("ab", '{"status":"ok","reason":"changed 1"}'), ("a e:no", '{"status":"fail","reason":"no"}'), ("x", '{"status":"skipped","reason":"disabled"}')])
_map = lambda c: F.from_json(c, "map<string,string>")
cases("map_values", lambda c: F.concat_ws("|", F.coalesce(assemble.map_get(_map(c), "Vara"), F.lit("-")), F.coalesce(assemble.map_first(_map(c), ["x", "VARA"]), F.lit("-")), shown(assemble.map_fill(_map(c), "Vara", F.lit("9")))), [
    ('{"VARA":"3"}', '3|3|{"VARA":"3"}'), ('{"vara":" ","x":"1"}', ' |1|{"x":"1","Vara":"9"}'), ('{"a":"b"}', '-|-|{"a":"b","Vara":"9"}'), ('{"Vara":"2","VARA":"3"}', '2|3|{"Vara":"2","VARA":"3"}'),
])
cases("json_filled", lambda c: assemble.json_fill(c, "k", F.lit("v")), [('{"a":"1"}', '{"a":"1","k":"v"}'), ('{"k":"2"}', '{"k":"2"}'), ('{"K":""}', '{"k":"v"}'), (None, '{"k":"v"}')])
