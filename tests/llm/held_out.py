"""Lines with personal data that the labelled table doesn't hold: other frames, names and formats, in four languages."""

NAMES = "Nina Weber|Hugo Blanc|Emma Clark|Greta Lehmann|Felix Baumann|Chloé Fontaine|Mateo Ibáñez|Inés Carrasco|Oliver Hughes|Zoë Kramer|Rahul Mehta|Beatriz Solano|Gaston Perrin|Heike Brandt|Samuel Whitfield|Akira Sato".split("|")
PHONES = "312-555-0188|555-9821|(333) 555-0147|030 8765432|089/445566|01 44 55 66 77|934 556 201|617.555.0162|0171 2345678|02 43 65 87 09".split("|")
IDS = "219-09-9999|321-54-9876|GB29NWBK60161331926819|DE12500105170648489890|FR7630006000011234567890189|ES7921000813610123456789|L898902C3|12345678Z|K4478120|701-22-4590".split("|")

LINES = {
    "en": """Contact: {NAME} in accounts|my name is {NAME} , pleased to meet you|Yours faithfully, hello from Mr. {NAME}|Dear Ms. {NAME} , thank you|Sincerely, {NAME}|Dr. {NAME} will see you now|the letter was signed by {NAME}|Name: {NAME}|Best regards, {NAME}|please ask for {NAME} at reception
her phone number is {PHONE}|call {PHONE} if it rings|Tel: {PHONE} (day)|Phone: {PHONE}|you can reach me on {PHONE} tonight|mobile {PHONE} only|his number is {PHONE} now|My SSN is {ID}|the passport number {ID} was wrong|IBAN: {ID} for the rent|social security number {ID} given|Tax ID {ID} missing""",
    "de": """Frau {NAME} ruft zurück|Herr {NAME} ist krank|Sehr geehrte Frau {NAME} , vielen Dank|Mein Name ist {NAME} .|Viele Grüße {NAME}|Ansprechpartner: {NAME} im ersten Stock|Name: {NAME}|Dr. {NAME} hat heute frei|Kontakt: {NAME}|wir sprechen mit Frau {NAME} darüber
Telefon: {PHONE}|Handy: {PHONE} abends|meine Nummer ist {PHONE} .|Sie erreichen mich unter {PHONE} ab acht|rufen Sie {PHONE}|Tel. {PHONE} im Büro|Steuer-ID {ID} fehlt|Reisepass {ID} verloren|IBAN: {ID} für Miete|Ausweis {ID} liegt vor|Sozialversicherungsnummer {ID} neu""",
    "fr": """Madame {NAME} est absente|Monsieur {NAME} vous attend|Cher Monsieur {NAME} , merci|Mme {NAME} arrive|Cordialement, {NAME}|Nom : {NAME}|Mon nom est {NAME} et voilà|signé par {NAME} à midi|Je m'appelle {NAME} .|Contact : {NAME} au bureau
téléphone: {PHONE}|Tél : {PHONE} le soir|mon numéro est le {PHONE} .|appelez le {PHONE}|portable {PHONE} svp|joignable au {PHONE} demain|passeport {ID} perdu|numéro de sécurité sociale {ID} reçu|mon IBAN est {ID} .|permis {ID} retiré|identité : {ID}""",
    "es": """Señora {NAME} llamó hoy|el señor Sr. {NAME} espera|Estimado {NAME} , gracias|Me llamo {NAME} .|Atentamente, {NAME}|Nombre: {NAME}|firmado por {NAME} en casa|Contacto: {NAME} abajo|Mi nombre es {NAME} y trabajo aquí|Saludos, {NAME}
teléfono: {PHONE}|llame al {PHONE} ya|mi número es {PHONE} .|móvil {PHONE} siempre|número de teléfono {PHONE} nuevo|celular: {PHONE}|DNI {ID} caducado|pasaporte {ID} nuevo|mi IBAN es {ID} .|seguridad social {ID} vieja|NIE {ID} pedido""",
}

PLAIN = """the house by the river was old|In 2004 we paid 17.20 for 3|Words Words Words Words|call the office after lunch|the contact was lost at sea|Chapter Nine: A Walk in the Snow|The University of the North opened in 1911|between 10 and 20 people came|flight 447 leaves at 18:45|Dear all , see below|my phone is broken|two passports and one visa|the invoice 2023-1187 is due|it weighs 12.5 kg in 2-3 boxes|Lake View Hotel has 120 rooms|section 12-4 of part 3|name and address are missing
und der Hund ist da|Die Regierung hat das Gesetz im Jahr 1990 beschlossen|Der Zug nach Norden fährt um 9.40 Uhr|Seite 33 bis 57 fehlen|Sehr geehrte Kundinnen und Kunden ,|Haus Nummer 12 ist leer|Das Telefon klingelt oft|Viele Grüße aus dem Urlaub|Teil 3 kostet 4,50 Euro|Im Sommer war die Straße gesperrt|Der Ausweis ist abgelaufen|Rechnung 99-1203 liegt bei|Herr der Lage|Kontakt nur schriftlich
le train part à 8h20 pour Lyon|Madame la présidente a parlé|il y a 14 maisons dans la rue|Le Musée de la Mer est fermé|Cordialement votre équipe|page 77 du livre 2|mon téléphone ne marche pas|en 1936 le prix était de 2,10|le passeport est obligatoire|Contact par courrier seulement|Rue du Moulin est longue|Nom et prénom obligatoires|la facture 2020-556 est payée
el tren sale a las 7:15 hacia Sevilla|la señora del tercero|hay 25 sillas en la sala 4|El Museo del Prado abre hoy|Atentamente le saluda|página 88 del tomo 5|mi teléfono no funciona|en 1978 costaba 3,20|el pasaporte es obligatorio|Contacto por correo|Calle Mayor está cerrada|Nombre y apellidos obligatorios|la factura 2020-556 está pagada""".replace("\n", "|").split("|")


def lines():
    """(language, text, [(kind, value)])."""
    k = 0
    for lang, templates in LINES.items():
        for t in templates.replace("\n", "|").split("|"):
            for _ in range(3):
                k += 1
                for slot, kind, values in (("{NAME}", "name", NAMES), ("{PHONE}", "local", PHONES), ("{ID}", "id", IDS)):
                    if slot in t:
                        value = values[(7 * k + 3) % len(values)]
                        yield lang, t.replace(slot, value), [(kind, value)]
    for t in PLAIN:
        yield "plain", t, []
