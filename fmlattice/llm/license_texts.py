"""License notices and texts that the scan looks for (fixed values, as their licences state them)."""

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice":
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    "ISC":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    "Apache-2.0-header":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-header":
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    "LGPL-header":
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    "MPL-2.0-header":
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "warranty-disclaimer":
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}

_BSD_2 = TEMPLATES["BSD-2-Clause"]
_GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {family}General "
        "Public License as published by the Free Software Foundation; either version {version} of the License, or (at your "
        "option) any later version.")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

# other versions and families
MORE = {
    "BSD-3-Clause":
        _BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    "EPL-1.0-header":
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0-header":
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "CC0-1.0-header":
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "MPL-1.1-header":
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
        "use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-1.0-header": _GPL.format(family="", version="1"),
    "GPL-2.0-header": _GPL.format(family="", version="2"),
    "AGPL-3.0-header": _GPL.format(family="Affero ", version="3"),
    "LGPL-2.1-program-header": _GPL.format(family="Lesser ", version="2.1"),
    "LGPL-3.0-program-header": _GPL.format(family="Lesser ", version="3"),
    "LGPL-2.0-header": _GPL.format(family="Library ", version="2").replace("program", "library"),
    "LGPL-3.0-header": _GPL.format(family="Lesser ", version="3").replace("program", "library"),
}
for _name, _family, _version in (("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("LGPL-2.0", "Library ", "2"),
                                 ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"),
                                 ("AGPL-3.0", "Affero ", "3")):
    MORE[f"{_name}-notice"] = f"This work is licensed under the GNU {_family}General Public License, version {_version}."
for _kind, _words in _CC.items():
    for _version, _where in _CC_VERSIONS.items():
        _old = (_kind, _version)
        if _old != ("BY-NC", "4.0"):
            MORE[f"CC-{_kind}-{_version}-short"] = f"Licensed under CC {_kind} {_version}."
        if _old not in (("BY", "4.0"), ("BY-SA", "4.0")):
            MORE[f"CC-{_kind}-{_version}-long"] = \
                f"This work is licensed under a Creative Commons {_words} {_version} {_where} License."
ALL = {**TEMPLATES, **MORE}
