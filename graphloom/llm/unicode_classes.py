"""Classes of code points as the public tokenizers library has them, whatever tables the interpreter and its pattern
engine come with: the library's are of several Unicode versions, newer ones for letters, older ones for normal forms.

Ranges in ascending order: the distance of the first code point from the end of
the range before, and after a plus how many more there are, in hexadecimal.
"""

from __future__ import annotations


def code_points(packed: str) -> frozenset[int]:
    out: list[int] = []
    last = 0
    for part in packed.split():
        first, _, more = part.partition("+")
        start = last + int(first, 16)
        last = start + int(more or "0", 16)
        out.extend(range(start, last + 1))
    return frozenset(out)


LETTERS = (
    "41+19 7+19 30 b 5 6+16 2+1e 2+1c9 5+b f+4 8 2 82+4 2+1 3+3 2 7 2+2 2 2+13 2+52 2+8a 9+a5 2+25 3 7+28 48+1a 5+3 2e+2a 24+1 2+62 2 10+1 8+1 b+2 3 11 "
    "2+1d 1e+58 c 19+20 a+1 5 6+15 5 a 4 18+18 8+a 6+17 2+5 12+29 3b+35 4 13 8+9 10+f 5+7 3+1 3+15 2+6 2 4+3 4 11 e+1 2+2 f+1 b 9+5 5+1 3+15 2+6 2+1 2+1 "
    "2+1 20+3 2 14+2 11+8 2+2 2+15 2+6 2+1 2+4 4 13 10+1 18 c+7 3+1 3+15 2+6 2+1 2+4 4 1f+1 2+2 10 12 2+5 4+2 2+3 4+1 2 2+1 4+1 4+2 4+b 17 35+7 2+2 2+16 "
    "2+f 4 1b+2 3 3+1 1f 5+7 2+2 2+16 2+9 2+4 4 20+1 2+1 10+1 12+8 2+2 2+28 3 11 6+2 9+2 19+5 6+11 4+17 2+8 2 3+6 3b+2f 2+1 d+6 3b+1 2 2+4 2+17 2 2+9 2+1 a "
    "3+4 2 16+3 21 40+7 2+23 1c+4 74+2a 15 11+5 5+3 4 4+1 8+2 5+c d 12+25 2 6 3+2a 2+14c 2+3 3+6 2 2+3 3+28 2+3 3+20 2+3 3+6 2 2+3 3+e 2+38 2+3 3+42 26+f "
    "11+55 3+5 4+26b 3+10 2+19 6+4a 7+7 8+11 e+12 f+11 f+c 2+2 10+33 24 5 44+58 8+4 3+21 2 6+45 b+1e 32+1d 3+4 c+2b 5+19 37+16 a+34 53 5e+2e 12+7 37+1d e+1 "
    "b+2b 1b+23 2a+2 b+23 3+a 6+2a 3+2 2a+3 2+5 2+1 4 6+bf 41+115 3+5 3+25 3+5 3+7 2 2 2 2+1e 3+34 2+6 2 4+2 2+6 4+3 3+5 5+c 6+2 2+6 75 e 11+c 66 5 3+9 2 "
    "4+4 7 2 2 2+3 2+a 3+3 6+4 5 35+1 a7c+e4 7+3 4+1 d+25 2 6 3+37 8 11+16 a+6 2+6 2+6 2+6 2+6 2+6 2+6 2+6 51 1d6+1 2b+4 6+1 5+55 7+2 2+59 2+3 6+2a 2+5d "
    "12+1f 31+f 201+19bf 41+568c 44+2d 3+10c 4+f b+1 15+2e 11+1e 3+45 32+8 3+66 3+42 3+1 2 2+7 16+f 2+2 2+3 2+16 1e+33 f+31 3f+5 4 2+1 c+1b b+16 1a+1c 8+2e "
    "1d 11+4 2+9 b+4 2+28 18+2 2+7 15+16 4 4+31 2 4+1 3+4 3 2 19+2 3+a 8+2 d+5 3+5 3+5 a+6 2+6 2+2a 2+d 7+72 1e+2ba3 d+16 5+30 2105+16d 3+69 27+6 d+4 6 2+9 "
    "2+c 2+4 2 2+1 2+1 2+6b 22+16a 13+3f 3+35 29+b 75+4 2+86 25+19 7+19 c+58 4+5 3+5 3+5 3+2 24+b 2+19 2+12 2+1 2+e 3+d 23+7a 186+1c 4+30 30+1f e+13 2+7 "
    "7+25 b+1d 3+23 5+7 31+9d 13+23 5+23 5+27 9+33 d+a 2+e 2+6 2+1 2+a 2+e 2+6 2+1 4+33 d+136 a+15 b+7 19+5 2+29 2+8 46+5 3 2+2b 2+1 4 3+16 b+16 a+1e 42+12 "
    "2+1 b+15 b+19 47+37 7+1 41 10+3 2+2 2+1c 2b+1c 4+1c 24+7 2+1b 1c+35 b+15 b+12 e+11 6f+48 38+32 e+32 e+23 27+1b a+16 fb+29 7+1 11+2 3c+1c b 9+15 2b+11 "
    "2f+14 1c+16 d+34 3a+1 3 e+2c 21+18 1b+23 1e 3 9+22 4 d+2f f+3 16 2 24+11 2+18 14+1 40+6 2 2+3 2+e 2+9 8+2e 27+7 3+1 3+15 2+6 2+1 2+4 4 13 d+4 1f+9 2 3 "
    "2+25 2 1a 2 2d+34 13+3 15+2 1f+2f 15+1 2 b9+2e 2a+3 25+2f 15 3c+2a e 48+1a 26+6 ba+2b 75+3f 20+7 3 3+7 2+1 2+17 10 2 5f+7 3+26 11 2 1d b+27 8 16 c+2d "
    "14 13+48 c8+20 20+8 2+24 12 32+1d 71+6 2+1 2+25 16 1a+5 2+1 2+1f f 148+12 10 2+c 2+21 7d 50+399 e7+c3 a4d+60 10+42f 12+5 1a+f9a 6+246 1aba+1d 6e3+238 "
    "8+1e 12+4e 12+1d 13+2f 11+3 20+14 6+12 1b1+2c d4+3f 81+4a 6 43+c 41+1 2 1d+17f7 9+4d5 2a+9 22e8+3 2+6 2+1 2+122 10 1e+2 3 f+3 9+18b 905+6a 6+c 4+8 8+9 "
    "1767+54 2+46 2+1 3 3+1 3+3 2+b 2 2+6 2+40 2+3 3+7 2+6 2+1b 2+3 2+4 2 4+6 2+153 3+18 2+18 2+1e 2+18 2+1e 2+18 2+1e 2+18 2+1e 2+18 2+7 735+1e 7+5 106+3d "
    "93+2c b+6 11 142+1d 13+2b 1e5+1b e5+1d 3 1f0+6 2+3 2+1 2+e 2+c4 3c+43 8 4b5+3 2+1a 2+1 2 3 2+9 2+3 2 2 7 5 2 2 2+2 2+1 2 3 2 2 2 2 2+1 2 3+3 2+6 2+3 "
    "2+3 2 2+9 2+10 6+2 2+4 2+10 1145+a6df 21+1039 7+dd 3+1681 f+1d30 10+26d 9a3+21d 5e3+134a 6+105f"
)

NUMBERS = (
    "30+9 79+1 6 3+2 5a2+9 87+9 c7+9 19d+9 77+9 5+5 6d+9 77+9 77+9 3+5 6f+c 74+9 9+6 68+9 69+6 8+12 6e+9 61+9 77+9 47+13 10d+9 47+9 2d0+13 372+2 f0+9 7+9 "
    "17+9 12d+9 81+a a6+9 7+9 b7+9 57+9 87+9 7+9 417 4+5 7+9 c7+32 3+4 2d7+3b 4f+15 277+1d 56a 30a 1a+8 f+2 158+3 8b+9 1f+7 2+e 21+9 28+e 7361+9 bd+9 141+5 "
    "9b+9 27+9 c7+9 17+9 57+9 197+9 5317+9 1ee+2c d+38 12+1 156+1a 25+3 1e 9 87+4 cb+9 3af+7 1a+6 28+8 4c+4 17+5 a1+1 3+f 3+2d 41+8 35+1 1f+2 4c+4 69+7 "
    "19+7 2a+6 14b+5 31+9 7+9 117+1e 9f+9 2b+3 71+6 87+1d 81+9 3d+9 91+9 8+13 fc+9 157+9 77+9 177+9 67+9 7+13 4d+b 1a5+12 5e+9 297+9 57+1c e4+9 47+9 1a7+9 "
    "67+14 42c+6e 3cc2+9 927+9 57+9 87+9 2+6 20f+9 107+16 5e5a+9 5c7+13 d+13 6d+18 456+31 941+9 1a7+9 1f7+9 f8+9 2cd+8 81+9 318+3a 2+2 2+3 4d+2c 2+e 3c3+c "
    "ae4+9"
)

#: Marks and letters that its normal forms know nothing of: they neither move nor join others.
INERT = (
    "7fd 9b+7 2b+9 12b 23e ff+1 17e 85b 3aa+f 328+4 8a32 64f8+3 184+1 51+2 47+a 32+3 eb 2cb 123 3db+1 f6 5 3 5+1 5 9d 54 13 52 2a9 2+1 52 1aa+1 50ae+1 709e "
    "a1+6 178 3e+3 1fd+3"
)

#: Capitals that it makes small and Unicode 15.1 doesn't.
SMALL = (
    "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50:10d70 10d51:10d71 10d52:10d72 10d53:10d73 10d54:10d74 10d55:10d75 "
    "10d56:10d76 10d57:10d77 10d58:10d78 10d59:10d79 10d5a:10d7a 10d5b:10d7b 10d5c:10d7c 10d5d:10d7d 10d5e:10d7e 10d5f:10d7f 10d60:10d80 10d61:10d81 "
    "10d62:10d82 10d63:10d83 10d64:10d84 10d65:10d85 16ea0:16ebb 16ea1:16ebc 16ea2:16ebd 16ea3:16ebe 16ea4:16ebf 16ea5:16ec0 16ea6:16ec1 16ea7:16ec2 "
    "16ea8:16ec3 16ea9:16ec4 16eaa:16ec5 16eab:16ec6 16eac:16ec7 16ead:16ec8 16eae:16ec9 16eaf:16eca 16eb0:16ecb 16eb1:16ecc 16eb2:16ecd 16eb3:16ece "
    "16eb4:16ecf 16eb5:16ed0 16eb6:16ed1 16eb7:16ed2 16eb8:16ed3 "
)
