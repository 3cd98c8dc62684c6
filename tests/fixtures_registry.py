"""Small registry files made up by rule: made-up companies whose key, capital and state follow from their number."""

import json
import zipfile

from regidx.fixed import ESTABLISHMENT_LAYOUT

STATES = ("AC", "PE", "GO")


def root(number):
    return f"{number * 1_010_101:08d}"


def check_digits(base):
    """The two digits that close a company key: weights 2 to 9 from the right, remainder to 11."""
    for _ in range(2):
        total = sum(int(digit) * (2 + place % 8) for place, digit in enumerate(reversed(base)))
        base += str(0 if total % 11 < 2 else 11 - total % 11)
    return base[-2:]


def key(number):
    """The key of a company's head office."""
    base = root(number) + "0001"
    return base + check_digits(base)


def formatted(number):
    k = key(number)
    return f"{k[:2]}.{k[2:5]}.{k[5:8]}/{k[8:12]}-{k[12:]}"


#: Number and name; the third company has none.
NAMES = {1: "MOINHO AURORA LTDA", 2: "TECELAGEM HORIZONTE SA", 3: ""}
COMPANIES = [(root(n), name, "2054", "10", f"{n}500,25", f"0{2 * n - 1}", "") for n, name in NAMES.items()]
#: Root, flag (1: head office), status, activity, state.
OFFICES = [
    (root(1), "1", "02", "1062700", STATES[0]),
    (root(2), "2", "02", "1321900", STATES[1]),
    (root(2), "2", "02", "1322700", STATES[2]),
    (root(77), "1", "02", "4711302", STATES[1]),
]
LISTED_NAMES = {1: ("MOINHO AURORA", STATES[0]), 5: ("ESTALEIRO DO VALE", STATES[1])}
LISTED = ["CNPJ_CIA;DENOM_SOCIAL;DENOM_COMERC;SIT;CD_CVM;SETOR_ATIV;TP_MERC;CATEG_REG;UF;MUN"] + [
    f"{formatted(n)};{name};{name.split()[0]};ATIVO;{900 + n};Industria;Balcao;Categoria B;{state};CIDADE {n}"
    for n, (name, state) in LISTED_NAMES.items()
]
PARTICIPANTS = [
    {"OrganisationId": "p5", "OrganisationName": "Estaleiro Pagamentos Ltda.", "RegistrationNumber": key(5),
     "Status": "Active", "City": "Recife", "Size": "Medium", "AuthorisationServers": [{"n": n} for n in range(3)]},
    {"OrganisationId": "p6", "OrganisationName": "Cooperativa Serra Azul", "RegistrationNumber": key(6),
     "Status": "Active", "City": "Goiania", "AuthorisationServers": []},
    {"OrganisationName": "sem numero de registro"},
]


def quoted(fields):
    return ";".join(f'"{field}"' for field in fields)


def office_row(base, flag, status, activity, state):
    named = {"cnpj_basico": base, "identificador_matriz_filial": flag, "situacao_cadastral": status,
             "cnae_fiscal_principal": activity, "uf": state}
    return quoted(named.get(column, "") for column in ESTABLISHMENT_LAYOUT)


def write_zip(path, member, lines):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr(member, ("\n".join(lines) + "\n").encode("latin-1"))


def write_landing(folder, offices=False):
    write_zip(folder / "Empresas0.zip", "K3241.K03200Y0.D40406.EMPRECSV", [quoted(row) for row in COMPANIES])
    (folder / "cad_cia_aberta.csv").write_bytes(("\n".join(LISTED) + "\n").encode("latin-1"))
    (folder / "open_finance_participants.json").write_text(json.dumps(PARTICIPANTS), encoding="utf-8")
    if offices:
        write_zip(folder / "Estabelecimentos0.zip", "K3241.K03200Y0.D40406.ESTABELE",
                  [office_row(*row) for row in OFFICES])
    return str(folder)
