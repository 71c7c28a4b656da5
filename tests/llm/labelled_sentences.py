"""Sentences labelled by hand: personal data between « and », with its kind; none of them comes from a generator."""

SENTENCES = [
    "You can reach me at «phone:555-867-5309» after six, or leave a note.",
    "Please call «phone:(212) 555-0147» and ask for the night desk.",
    "My old number, «phone:415.555.2671», no longer works.",
    "Rufen Sie uns an: Tel. «phone:0301 4567890», werktags von 9 bis 17 Uhr.",
    "Telefon «phone:0711/482913», Fax auf Anfrage.",
    "Appelez le «phone:06 12 34 56 78» pour confirmer avant 18:30.",
    "Bureau: «phone:01 44 21 38 90», ouvert du lundi au vendredi.",
    "From abroad dial «phone:0049 30 901 8200» and wait for the tone.",
    "Llame al «phone:912 345 678» de lunes a viernes.",
    "The courier's mobile is «phone:+44 7700 900 123», please text first.",
    "Office line: «phone:+1 (303) 555-0199»; the fax is broken.",
    "Write to jane, that is «email:jane.doe at example dot com», any time.",
    "Contact: «email:support [at] northwind [dot] org» for refunds.",
    "Send the form to «email:billing(at)acme(dot)co(dot)uk» before Friday.",
    "For access write to «email:m.keller (at) uni-bonn dot de» please.",
    "Her address is «email:a_smith+news@mail.example.org», I think.",
    "Mail «email:info @ example.net» with your order.",
    "The attacker used «ip:203[.]0[.]113[.]77» for two days.",
    "Block «ip:198[.]51[.]100[.]4» and rotate the keys.",
    "Host «ip:192.0.2.45» answered after 12 ms.",
    "The card «card:4929 1234 5678 9012» was declined twice.",
    "He typed «card:4111.1111.1111.1111» into the wrong field.",
    "Payment by «card:5500-0000-0000-0004» went through on 2024-03-11.",
    "Kartennummer «card:4539578763621486», gültig bis 05/27.",
    "Card on file: «card:3782 822463 10005», expires 11/29.",
    "Número de tarjeta: «card:4716 0259 8371 6640».",
    "Both cards, «card:4485275742308327» and «card:6011 0009 9013 9424», are blocked.",
    # nothing personal in the following ones
    "The meeting is on 2024-06-11 at 14:30:00 in room 204.",
    "ISBN 978-3-16-148410-0, second edition, 432 pages.",
    "Order A-10023-77 contains 12 items worth $1,299.00.",
    "Version 10.4.2 fixes bug #48213 and the build of 12.05.2023.",
    "The population grew from 1,204,331 to 1,310,002 between 1990-2020.",
    "Commit 9f86d081884c7d659a2feaa0c55ad015 broke the parser.",
    "The job ran at 1718123456789 and again at 20240611143000.",
    "See pages 120-134 and section 4.2.1 of the manual.",
    "Die Strecke misst 10 000 000 Schritte, also etwa 7.500.000 Meter.",
    "Paris lies at 48.85661, 2.35222 and has 20 districts.",
    "Meet me at the corner, the dot on the map, around 7.",
    "Follow @northwind and reply with #42 before noon.",
    "She scored 98.6% in 3 of 4 rounds, 2 + 2 = 4 notwithstanding.",
    "Le train de 18:05 arrive à 21:47, voie 12, voiture 8.",
    "Serial GX4T-99KQ-71ZP-0042 is engraved on the back.",
    "La factura 2024/00317 asciende a 1.250,75 euros.",
    "Tracking 123456789012345678901234 shows no movement since Monday.",
    "Add 250 g of flour, 3 eggs and 0.5 l of milk; bake 45 min at 180.",
    "Zip codes 90210 and 10115 are listed on line 17.",
]


def parsed() -> list[tuple[str, set[tuple[str, int, int]]]]:
    """(text, spans) of every sentence."""
    out = []
    for s in SENTENCES:
        text, spans = "", set()
        for i, piece in enumerate(s.replace("»", "«").split("«")):
            if i % 2:
                kind, thing = piece.split(":", 1)
                spans.add((kind, len(text), len(text) + len(thing)))
                piece = thing
            text += piece
        out.append((text, spans))
    return out
