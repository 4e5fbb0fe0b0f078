"""Word lists and tables that decide results."""

# Terms of labels beside which a value identifies a person.
STRONG = frozenset(
    "aadhaar aadhar uid vid pan passport voter epic licence license dl ration abha gstin tan uan "
    "mobile phone telephone email mail pin pincode postcode zip "
    "account acct ac iban upi vpa micr ifsc folio crn cif customer "
    "uhid mrn patient sample specimen lab "
    "policy claim fir pnr ticket booking case complaint diary "
    "survey khasra khesra khata khatauni khewat dag jamabandi patta chitta pahani satbara plot deed "
    "vehicle registration reg chassis engine rc "
    "आधार मोबाइल पैन खाता दूरभाष "
    "nik nama alamat lahir agama darah kecamatan kelurahan desa rt rw".split()
)
# Terms that do so where the label is about a person.
WEAK = frozenset("name address contact signature nominee guardian father mother husband spouse dob birth age doctor physician surgeon practitioner nurse नाम पता हस्ताक्षर".split())
# Terms of institutions, which veto the weak ones.
INSTITUTION = frozenset(
    "branch bank hospital clinic company firm office department station institution school college university insurer issuer authority board corporation ltd "
    "limited helpline website cin gst scheme product merchant vendor organisation organization employer".split()
)
# Words without weight in a label.
FILLER = frozenset(
    "no nos number num id code details detail of the for if any self employed please enter registered full permanent present current correspondence "
    "communication residential primary alternate applicant holder s and or in as per type date "
    "tempat tgl tanggal gol jenis kelamin kel status perkawinan pekerjaan kewarganegaraan berlaku hingga".split()
)
VOCABULARY = STRONG | WEAK | INSTITUTION | FILLER

#: What is punctuation in a label: all but letters, digits, spaces and the Devanagari block; and underscores.
LABEL_PUNCTUATION = r"[^\p{L}\p{N}\sऀ-ॿ]+|_+"

# Words beside which a signature is looked for.
SIGNATURE_CUES = ("sign", "signature", "signatures", "signatory", "signed", "authorised", "authorized")

# What a model's kinds of value are called as regions.
REPLY_KINDS = {"name": "vlm_name", "address": "vlm_address", "phone": "vlm_phone", "email": "vlm_email", "dob": "vlm_dob", "id_number": "vlm_id", "signature": "vlm_signature"}


def _dihedral() -> list[list[int]]:
    """Products in the symmetries of a pentagon: 0 to 4 turn, 5 to 9 turn and flip."""
    return [[(a + (b if a < 5 else -b)) % 5 + (5 if (a < 5) != (b < 5) else 0) for b in range(10)] for a in range(10)]


def _turns() -> list[list[int]]:
    """The powers of the check's permutation."""
    rows = [list(range(10))]
    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # Fixed value: Verhoeff's permutation.
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return rows


VERHOEFF_PRODUCT, VERHOEFF_TURN = _dihedral(), _turns()
