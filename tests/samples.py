"""Invented sample texts: a medical record, a staff card, a transfer slip, and Unicode."""

MEDICAL = """Case 7 of the Elm Row clinic
Patient: Tobias Grell | DOB: 07/21/1969
SSN: 351-48-2207; MRN: MRN-77310425
Seen on 2023-05-16 by the ward
Diagnosis: Chronic migraine (G43.7)
Medications: Topiramate 25mg at night
Insurance ID: NWH-4482-19
Reach: t.grell@mailbox.example or (617) 555-0143"""

STAFF = """Staff card
Employee ID: EMP-90317 (Ingrid Solheim)
SSN: 417-62-5038, DOB: May 2, 1991
Call +1 (503) 555-0178 or mail
ingrid.solheim@fjordworks.example
Lives at 88 Harbor Mill Rd SW, Portland, OR 97201
Salary: $71,250 per year
Bank Account: 8123456790, Routing: 125000024"""

BANK = """Transfer slip for L. Okonjo
Paid by card: 5555 3412 4444 1115 (valid to 04/29, CVV: 306)
IBAN: DE89370400440532013000
Routing: 122105155
Sum: $12,040.75
Reply to: l.okonjo@savings.example
Passport No: K40728815"""

UNICODE = (
    "\U0001F600 abcde1234f x CVV 847 é +91 91360 32205; Mr Johnsonx 12345-6789 by 30309 "
    "NPI#1234567890 2345 6789 0123 aba 123456789 12 Main St\nRoad"
)
