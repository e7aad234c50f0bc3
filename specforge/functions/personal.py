"""Which column names tell of a person: runs of name parts, by the categories of identifiers that health-privacy rules list."""

from __future__ import annotations

import re

#: Fixed values. A run of name parts = the provider of stand-ins; longer runs are tried first.
RULES = """
first name = first_name; given name = first_name; forename = first_name; firstname = first_name; middle name = first_name; christian name = first_name
last name = last_name; family name = last_name; surname = last_name; lastname = last_name; maiden name = last_name; second name = last_name
full name = name; fullname = name; name = name; patient = name; contact person = name; customer contact = name; next of kin = name; spouse = name; guardian = name
user name = user_name; username = user_name; login = user_name; nickname = user_name; screen name = user_name
street = street_address; street address = street_address; address line = street_address; house number = street_address; address = address; home address = address; mailing address = address; residence = address
city of birth = city; zip = zipcode; zip code = zipcode; zipcode = zipcode; postcode = postcode; postal code = postcode; post code = postcode
latitude = latitude; longitude = longitude; geo location = latitude; gps = latitude
date of birth = date_of_birth; birth date = date_of_birth; birthdate = date_of_birth; birthday = date_of_birth; birth = date_of_birth; dob = date_of_birth; date of death = date_of_birth; death date = date_of_birth; admission date = date_of_birth; discharge date = date_of_birth
phone = phone_number; telephone = phone_number; mobile = phone_number; cell phone = phone_number; cellphone = phone_number; tel = phone_number; fax = phone_number; pager = phone_number
email address = email; email = email; e mail = email; mail address = email
ssn = ssn; social security = ssn; national insurance = ssn; national identity = ssn; tax number = ssn; sin number = ssn
medical record = bothify; mrn = bothify; health plan = bothify; beneficiary number = bothify; member number = bothify; insurance number = bothify; policy holder = name
account number = bban; account no = bban; bank account = bban; sort code = bban; routing number = bban; iban = iban; swift code = swift; credit card = credit_card_number; card number = credit_card_number; cvv = credit_card_number
license number = license_plate; licence number = license_plate; driver license = license_plate; driver licence = license_plate; drivers license = license_plate; license plate = license_plate; licence plate = license_plate; plate = license_plate; certificate number = bothify; passport = passport_number
vin = bothify; vehicle identification = bothify; device serial = bothify; serial number = bothify; imei = bothify; mac address = mac_address; mac = mac_address
ip address = ipv4; ip = ipv4; ipv4 = ipv4; ipv6 = ipv6; personal url = url; home page = url; profile url = url
fingerprint = bothify; voiceprint = bothify; retina = bothify; face image = bothify; photo = bothify; biometric = bothify; signature image = bothify
"""
#: Fixed values. Parts that say the named thing is no person.
THINGS = """
account app application artifact attribute bank brand branch bucket build business campaign category channel chart city class cluster code collection color column
company component computer container country course currency database dataset department device dimension directory disk district domain
endpoint engine entity environment error event experiment feature field file folder font format function game group host hotel image index
industry instance item job key label language layer league library list machine market material message method metric model module nation
network node object operation organisation organization package page parameter part partner pipeline plan plant platform plugin policy port
process product profile program project property protocol provider queue region repository resource role route rule schema school sector
segment sensor server service ship shop site state station status step store stream street subject supplier system table tag task team
template test theme thread title tool topic type unit university vendor version warehouse website widget workflow
"""


def _parse(text: str) -> list[tuple[tuple[str, ...], str]]:
    found = [tuple(x.split("=")) for x in re.split(r"[;\n]", text) if "=" in x]
    return sorted(((tuple(run.split()), provider.strip()) for run, provider in found), key=lambda x: -len(x[0]))


_RUNS = _parse(RULES)
_THINGS = set(THINGS.split())


def name_tokens(name: str) -> list[str]:
    """The parts of a name: at blanks, signs, digits and capitals."""
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def id_like(name: str) -> bool:
    """Whether the last part says key or identifier: `rec_id`, `orderId`, `ID`; not `paid`."""
    return name_tokens(name)[-1:] in (["id"], ["key"], ["pk"], ["uuid"], ["guid"])


def personal(name: str) -> str | None:
    """The provider of stand-ins for what a column of this name holds of a person, or None."""
    parts = name_tokens(name)
    if not parts or id_like(name):
        return None
    for run, provider in _RUNS:
        for i in range(len(parts) - len(run) + 1):
            if tuple(parts[i : i + len(run)]) == run:
                if provider in ("name", "user_name") and set(parts[:i]) & _THINGS or len(run) == 1 and provider not in ("email", "ssn", "phone_number") and set(parts[:i]) & _THINGS:
                    return None
                return provider
    return None
